"""Toxicity as an ordinal severity: cumulative-link regression on sparse words.

P(grade <= k) = sigmoid(cut_k - w . x): one weight for each feature, shared by all ordered cuts. Features
are log(1 + count) of lower-cased words and of their first 4 to 7 bytes, hashed to 2^20 buckets. The result of a text is its expected grade and P(grade >= 1).

Labels say toxic or not; severity is graded from the training sample itself: a toxic text's marked features
are those features that are much more frequent in toxic texts (a smoothed log-odds ratio above ``MARKED``), and its
grade is 1, 2 or 3 by the third of the toxic texts in which their number lies. A text that isn't toxic has grade 0.

The model is fitted on a bounded sample: at most ``SAMPLE`` labelled documents of each class, those with
the smallest hash of doc_id, and the features whose odds of being in a toxic text differ by at least
``LEAST_Z`` standard errors. Features are counted where the texts are; the driver gets a count for each
bucket (2^20 at most), and then each sampled document's counts of the chosen features, never a text.
Scoring reads every whole text.

Defined results: null or empty texts have no words and get the model's base rate; without labels of both
classes every text has severity 0; of repeated labels of a document the highest counts, and of several texts
of a sampled doc_id the one with the smallest hash; ties in the number of marked features have one grade;
repeated documents are scored alike; extra columns are left behind.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinql.llm.common import arrow_column, dropped, released, table_of, written

SAMPLE = 2500
LEAST_DOCS = 3
LEAST_Z = 3.5
MARKED = 3.0
GRADES = 4
EPOCHS = 160
RIDGE = 1e-3
RATE = 0.05
PREFIXES = (4, 5, 6, 7)
CACHE_WORDS = 300_000
BUCKETS = 1 << 20

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters; A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def features_of(word: bytes) -> list[int]:
    """Buckets of a word, marked by a space at its end, and of its first 4 to 7 bytes, so that inflected forms share some."""
    import xxhash

    forms = [word + b" ", *(word[:n] for n in PREFIXES if len(word) >= n)]
    return [xxhash.xxh32_intdigest(f) % BUCKETS for f in forms]


class _Known(dict):
    """Word -> the places of its features in a model; a bounded cache."""

    def __init__(self, places: np.ndarray) -> None:
        super().__init__()
        self.places = places

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > CACHE_WORDS:
            self.clear()
        found = self[word] = tuple(p for p in self.places[features_of(word)].tolist() if p >= 0)
        return found


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets ascending, counts) of a text."""
    ids = np.fromiter((b for w, n in Counter(words_of(text)).items() for b in features_of(w) * n), np.int32)
    return np.unique(ids, return_counts=True)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    """Feature weights and ordered cuts; without cuts everything has severity 0. places: bucket -> number of its weight, or -1."""

    places: np.ndarray = field(default_factory=lambda: np.full(BUCKETS, -1, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    cuts: np.ndarray = field(default_factory=lambda: np.empty(0))

    def __post_init__(self) -> None:
        self._known = _Known(self.places)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """w . x of each text."""
        out, known = np.zeros(len(texts)), self._known
        for n, t in enumerate(texts):
            found = np.fromiter(chain.from_iterable(map(known.__getitem__, words_of(t))), np.int64)
            own, count = np.unique(found, return_counts=True)
            out[n] = np.log1p(count) @ self.weights[own]
        return out

    def above(self, texts: list[str | None]) -> np.ndarray:
        """texts x cuts: the probability of a grade above each cut. Their sum is the expected grade."""
        return _sigmoid(self.score(texts)[:, None] - self.cuts[None, :])


def contrasts(found: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the smoothed log-odds ratio of being in a toxic text, and the same in standard errors (0 for rare ones)."""
    n = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for (own, _), t in zip(found, toxic):
        n[int(t)][own] += 1
    return _contrasts(n[0], n[1], int((toxic == 0).sum()), int((toxic == 1).sum()))


def _contrasts(in_clean: np.ndarray, in_toxic: np.ndarray, clean: int, toxic: int) -> tuple[np.ndarray, np.ndarray]:
    cells = [x + 0.5 for x in (in_toxic, toxic - in_toxic, in_clean, clean - in_clean)]
    ratio = np.log(cells[0] * cells[3] / (cells[1] * cells[2]))
    ratio[in_clean + in_toxic < LEAST_DOCS] = 0
    return ratio, ratio / np.sqrt(sum(1 / c for c in cells))


def severity_grades(found: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> np.ndarray:
    """Grades 0 to 3 of a labelled sample."""
    ratio, z = contrasts(found, toxic)
    marked = (ratio > MARKED) & (z >= LEAST_Z)
    count = np.array([n[marked[own]].sum() for own, n in found])
    cut = np.quantile(count[toxic == 1], [1 / 3, 2 / 3], method="lower")
    return np.where(toxic == 0, 0, 1 + (count > cut[0]) + (count > cut[1]))


@dataclass
class Sample:
    """A graded sample as sparse rows (row, col, val): val is log(1 + count) of feature col in document row. y: grades from 0 without gaps."""

    row: np.ndarray
    col: np.ndarray
    val: np.ndarray
    y: np.ndarray
    share: np.ndarray
    features: int
    cuts: int

    def parts(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights, cuts) of parameters: weights, the first cut, logarithms of the steps to the next ones, so that cuts stay ordered."""
        steps = np.exp(p[self.features + 1 :])
        return p[: self.features], p[self.features] + np.concatenate([[0.0], np.cumsum(steps)])

    def loss(self, p: np.ndarray) -> float:
        """Mean negative log likelihood by shares, with a ridge on the weights."""
        w, cuts = self.parts(p)
        s = np.bincount(self.row, self.val * w[self.col], len(self.y))
        mass = _sigmoid(np.append(cuts, np.inf)[self.y] - s) - _sigmoid(np.append(-np.inf, cuts)[self.y] - s)
        return float(-(self.share * np.log(np.maximum(mass, 1e-12))).sum() + RIDGE / 2 * (w @ w))

    def gradient(self, p: np.ndarray) -> np.ndarray:
        w, cuts = self.parts(p)
        s = np.bincount(self.row, self.val * w[self.col], len(self.y))
        hi, lo = _sigmoid(np.append(cuts, np.inf)[self.y] - s), _sigmoid(np.append(-np.inf, cuts)[self.y] - s)
        mass = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / mass * self.share, lo * (1 - lo) / mass * self.share
        g_w = np.bincount(self.col, self.val * (d_hi - d_lo)[self.row], self.features) + RIDGE * w
        g_cut = -np.bincount(self.y, d_hi, self.cuts + 1)[: self.cuts] + np.bincount(self.y, d_lo, self.cuts + 1)[1:]
        tail = np.cumsum(g_cut[::-1])[::-1]
        return np.concatenate([g_w, [tail[0]], tail[1:] * np.exp(p[self.features + 1 :])])


def graded_sample(found: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> tuple[Sample, np.ndarray]:
    """The sample's chosen features, classes weighted alike; and where each bucket's weight is, or -1."""
    grade = severity_grades(found, toxic)
    chosen = np.flatnonzero(np.abs(contrasts(found, toxic)[1]) >= LEAST_Z)
    places = np.full(BUCKETS, -1, np.int32)
    places[chosen] = np.arange(len(chosen))
    kept = [(places[own] >= 0) for own, _ in found]
    row = np.repeat(np.arange(len(found)), [k.sum() for k in kept])
    col = np.concatenate([places[own[k]] for (own, _), k in zip(found, kept)]).astype(np.int64)
    val = np.log1p(np.concatenate([n[k] for (_, n), k in zip(found, kept)]))
    present = sorted(set(grade.tolist()) - {0})  # a cut below each grade that occurs
    share = np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (toxic == 0).sum()))
    return Sample(row, col, val, np.searchsorted([0, *present], grade), share, len(chosen), len(present)), places


def fit_ordinal(found: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> OrdinalModel:
    """Fit by gradient steps (Adam) on the mean log likelihood. found: (buckets ascending, counts) of each document; of features that aren't chosen none need be there."""
    if len(set(toxic.tolist())) < 2:
        return OrdinalModel()
    sample, places = graded_sample(found, toxic)
    p = np.concatenate([np.zeros(sample.features), [1.0], np.zeros(sample.cuts - 1)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, EPOCHS + 1):
        g = sample.gradient(p)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return OrdinalModel(places, *sample.parts(p))


def _features(texts: pa.Array, chosen: np.ndarray | None = None) -> pa.Array:
    """struct(own, n) of each text; with chosen, only of these buckets."""
    rows = [counted(t.as_py()) for t in texts]
    if chosen is not None:
        rows = [(own[chosen[own]], n[chosen[own]]) for own, n in rows]
    lists = [pa.array([x.astype(np.int32) for x in column], pa.list_(pa.int32())) for column in (zip(*rows) if rows else ((), ()))]
    return pa.StructArray.from_arrays(lists, names=["own", "n"])


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(buckets, counts) of the chosen features of each sampled document, and its label."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    few = known.where("toxic = 0").orderBy(*order).limit(sample).unionByName(known.where("toxic <> 0").orderBy(*order).limit(sample))
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.struct(F.xxhash64(text).alias("h"), text.alias("text")).alias("one")).where(text.isNotNull()).join(F.broadcast(few), "doc_id")
    rows = written(rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("one")["text"].alias("text")), "toxic-sample")
    kind = "struct<own:array<int>,n:array<int>>"

    def every(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                yield _features(batch.slice(at, 256))

    seen = rows.select((F.col("toxic") != 0).cast("int").alias("toxic"), F.explode(arrow_column(every, kind)(F.col("text"))["own"]).alias("bucket"))
    seen = seen.groupBy("bucket").agg(F.count("*").alias("docs"), F.sum("toxic").alias("toxic")).where(F.col("docs") >= LEAST_DOCS).toArrow()
    n = {bool(r["t"]): r["n"] for r in rows.groupBy((F.col("toxic") != 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    in_toxic, in_any = np.zeros(BUCKETS), np.zeros(BUCKETS)
    in_toxic[seen.column("bucket").to_numpy()], in_any[seen.column("bucket").to_numpy()] = seen.column("toxic").to_numpy(), seen.column("docs").to_numpy()
    chosen = np.abs(_contrasts(in_any - in_toxic, in_toxic, n.get(False, 0), n.get(True, 0))[1]) >= LEAST_Z

    def those(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                yield _features(batch.slice(at, 256), chosen)

    got = rows.select("doc_id", "toxic", arrow_column(those, kind)(F.col("text")).alias("f")).orderBy("doc_id").collect()  # 2 * SAMPLE rows at most
    dropped(rows)
    return [(np.array(r.f.own, np.int32), np.array(r.f.n, np.int64)) for r in got], np.array([int(r.toxic != 0) for r in got], np.int64)


def grade_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, severity, p_toxic, toxic) of every document: severity is the expected grade."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's vocabulary

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            above = np.concatenate([sent.value.above([t.as_py() for t in batch.slice(at, 512)]) for at in range(0, len(batch), 512)] or [np.zeros((0, 0))])
            p = above[:, 0] if above.shape[1] else np.zeros(len(above))
            yield pa.StructArray.from_arrays([pa.array(above.sum(axis=1)), pa.array(p), pa.array(p >= 0.5)], names=["severity", "p_toxic", "toxic"])
        released()

    kind = "struct<severity:double,p_toxic:double,toxic:boolean>"
    return docs.select(F.col(id_col).alias("_id"), arrow_column(run, kind)(F.col(text_col).cast("string")).alias("_v")).select(F.col("_id").alias(id_col), "_v.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_of(spark, sf_dir, "documents")
    return grade_toxicity(docs, fit_ordinal(*training_sample(docs, table_of(spark, sf_dir, "labels"))))

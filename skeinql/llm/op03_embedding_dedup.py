"""Near-duplicate embeddings by counting collisions in many sorted one-dimensional projections.

Each of ``tables`` tables deals the vectors of a label out by the signs of a few projections and sorts
them by one more. Two vectors collide in a table when their signs agree and the second lies in the
window of width ``w`` centred on the first. Both have known probabilities for a pair at the threshold
angle (1 - angle/pi for a sign, a normal tail for the window), so the number of tables and the count a
pair must reach are set by the recall wanted (RECALL), however the vectors are spread; the number of
signs grows with the logarithm of the largest label, so parts stay small. Pairs that pass are verified
by cosine in double precision.

A pair is looked at in the first table where it collides, where all its collisions are counted from the
two vectors; so pairs are neither shuffled nor counted twice. A task returns a partial number of links
for each vector and a forest of links, never pairs. Parts of more than BLOCK vectors are cut in blocks,
and each two blocks meet in a task. Equal vectors of a label are one vector with a multiplicity.

Defined results: a vector that is null, zero, or holds null or non-finite components, or whose label is
null, links with nothing and is its own component; vectors of different length don't link; repeated rows
are vectors of their own, linked with their copies; a null vec_id has a null component unless it is
linked to one that isn't null; an empty table gives an empty result; extra columns are left behind.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinql.llm.common import connected_components, dropped, labels_of, released, table_of, written
from skeinql.llm.dart_minhash import mix

THRESHOLD = 0.98
RECALL = 0.9999
PART = 32  # vectors of a label that a part holds if they are spread evenly
BLOCK = 2048
SEED = 7


def _at_least(n: int, p: float, least: int) -> float:
    return 1 - sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(least))


def calibrated(largest: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int, int, float]:
    """(signs, tables, count, window) for labels of up to so many vectors."""
    signs = min(40, max(0, math.ceil(math.log2(max(1, largest) / PART))))
    window = 3 * math.sqrt(2 - 2 * threshold)
    p = (1 - math.acos(threshold) / math.pi) ** signs * math.erf(3 / math.sqrt(2))
    tables = next(n for n in range(12, 10_000) if _at_least(n, p, 2) >= recall)
    count = max(c for c in range(1, tables + 1) if _at_least(tables, p, c) >= recall)
    return signs, tables, count, window


def _directions(dim: int, tables: int, signs: int) -> tuple[np.ndarray, np.ndarray]:
    """Normal directions: dim x tables for the sorted projections, dim x (tables * signs) for the signs."""
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((dim, tables)), rng.standard_normal((dim, tables * signs))


def _codes(vectors: np.ndarray, hyper: np.ndarray, tables: int, signs: int) -> np.ndarray:
    """vectors x tables: the signs as a number."""
    if not signs:
        return np.zeros((len(vectors), tables), np.uint64)
    bits = (vectors @ hyper > 0).reshape(len(vectors), tables, signs)
    return (bits * (np.uint64(1) << np.arange(signs, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)


def _prepared(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("uid"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            same, raw = [], []
            for label, vec in zip(batch.column("label").to_pylist(), batch.column("vec")):
                v = vec.values.to_numpy(zero_copy_only=False) if vec.is_valid and label is not None else np.empty(0)
                ok = len(v) and v.dtype == np.float64 and np.isfinite(v).all() and np.isfinite(v @ v) and v @ v > 0
                raw.append((v + 0.0).astype("<f8").tobytes() if ok else None)  # -0.0 becomes 0.0
                same.append(xxhash.xxh3_128_digest(label.encode() + b"\0" + raw[-1]) if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("uid"), batch.column("label"), pa.array(same, pa.binary()), pa.array(raw, pa.binary())], names=["id", "uid", "label", "same", "vec"])

    return src.mapInArrow(run, "id long, uid long, label string, same binary, vec binary")


def _keyed(reps: DataFrame, signs: int, tables: int) -> DataFrame:
    """(uid, vec, times, keys): in each table the hash of a vector's label, length and signs. They are made once and carried, so that they can't differ between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            size = pc.binary_length(batch.column("vec")).to_numpy()
            keys = np.empty((batch.num_rows, tables), np.int64)
            labels = np.array([xxhash.xxh3_64_intdigest(x) for x in batch.column("label").to_pylist()], np.uint64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                v = np.frombuffer(b"".join(batch.column("vec").take(pa.array(at)).to_pylist()), "<f8").reshape(len(at), -1)
                _, hyper = _directions(int(s) // 8, tables, signs)
                code = _codes(v, hyper, tables, signs)
                keys[at] = mix(mix(code + mix(labels[at] + np.uint64(s))[:, None]) + np.arange(1, tables + 1, dtype=np.uint64)).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("uid", "vec", "times")), lists], names=["uid", "vec", "times", "keys"])
        released()

    return reps.select("uid", "label", "vec", "times").mapInArrow(run, "uid long, vec binary, times long, keys array<long>")


def _parts(keyed: DataFrame) -> DataFrame:
    """(key, t, uid, side, crossed): groups of at most about two blocks whose pairs are sought; crossed: between sides only."""
    rows = keyed.select("uid", F.posexplode("keys").alias("t", "key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = rows.join(sizes.hint("merge"), "key")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("uid"), blocks).cast("int")
    shared = shared.withColumns({"blocks": blocks, "own": own}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return shared.select(F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", low, high)).alias("key"), "t", "uid", (F.col("own") == high).cast("int").alias("side"), (low != high).alias("crossed"))


def _counted(parts: DataFrame, keyed: DataFrame, signs: int, tables: int, count: int, window: float, threshold: float) -> DataFrame:
    """(a, b, n): partial numbers of links (b null), and links that join the same components as all (n null)."""
    rows = parts.join(keyed, "uid").repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
            size = pc.binary_length(t.column("vec")).to_numpy()
            for s in np.unique(size):
                yield from one_length(t.filter(pa.array(size == s)) if len(np.unique(size)) > 1 else t, int(s) // 8)

        def one_length(t: pa.Table, dim: int) -> Iterator[pa.RecordBatch]:
            key, table, uid, side, times = (t.column(c).to_numpy() for c in ("key", "t", "uid", "side", "times"))
            crossed = t.column("crossed").to_numpy()
            v = np.frombuffer(b"".join(t.column("vec").to_pylist()), "<f8").reshape(len(key), dim)
            norm = np.sqrt(np.einsum("ij,ij->i", v, v))
            place = (v / norm[:, None]) @ _directions(dim, tables, signs)[0]
            code = pc.list_flatten(t.column("keys")).to_numpy().reshape(-1, tables)
            own = place[np.arange(len(key)), table]
            group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
            # groups one after another on a line, too far apart for a window to reach the next
            x = own + group * (4 * np.abs(own).max() + 4 * window)
            order = np.argsort(x, kind="stable")
            reach = np.searchsorted(x[order], x[order] + window, "right") - np.arange(len(x)) - 1
            ends = np.cumsum(reach)
            links_i, links_j = [], []
            for lo in range(0, int(ends[-1]), 40_000):
                hi = min(lo + 40_000, int(ends[-1]))
                pair = np.arange(lo, hi)
                row = np.searchsorted(ends, pair, "right")
                i, j = order[row], order[pair - (ends[row] - reach[row]) + row + 1]
                ok = (group[i] == group[j]) & ~(crossed[i] & (side[i] == side[j])) & (uid[i] != uid[j])
                i, j = i[ok], j[ok]
                hit = (code[i] == code[j]) & (np.abs(place[i] - place[j]) <= window)
                ok = (hit.argmax(axis=1) == table[i]) & (hit.sum(axis=1) >= count)
                i, j = i[ok], j[ok]
                ok = np.einsum("ij,ij->i", v[i], v[j]) / (norm[i] * norm[j]) >= threshold
                links_i.append(i[ok])
                links_j.append(j[ok])
            if not links_i:
                return
            i, j = np.concatenate(links_i), np.concatenate(links_j)
            if not len(i):
                return
            n = np.bincount(i, times[j], len(key)) + np.bincount(j, times[i], len(key))
            label = labels_of(len(key), i, j)
            some, joined = np.flatnonzero(n), np.flatnonzero(label != np.arange(len(key)))
            none = np.zeros(len(some) + len(joined), bool)
            a = np.concatenate([uid[some], uid[joined]])
            b = pa.array(np.concatenate([np.zeros(len(some), np.int64), uid[label[joined]]]), mask=np.arange(len(none)) < len(some))
            m = pa.array(np.concatenate([n[some], np.zeros(len(joined))]).astype(np.int64), mask=np.arange(len(none)) >= len(some))
            yield pa.RecordBatch.from_arrays([pa.array(a), b, m], names=["a", "b", "n"])

        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = t.column("key").to_numpy()
            cut = int(np.flatnonzero(key == key[-1])[0])
            if cut:
                yield from found(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield from found(held)

    return rows.select("key", "t", "uid", "side", "crossed", "vec", "times", "keys").mapInArrow(run, "a long, b long, n long")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row of vectors."""
    rows = written(_prepared(vectors, id_col, vec_col, label_col), "embed-rows")
    some = rows.where("same IS NOT NULL")
    reps = written(some.groupBy("same").agg(F.min("uid").alias("uid"), F.first("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("times")), "embed-reps")
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    signs, tables, count, window = calibrated(largest, threshold, recall)
    keyed = written(_keyed(reps, signs, tables), "embed-keys")
    counted = written(_counted(_parts(keyed), keyed, signs, tables, count, window, threshold), "embed-links")
    dropped(keyed)
    links = counted.where("b IS NULL").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("n"))
    component = connected_components(counted.where("b IS NOT NULL").select("a", "b"), "embed-components").withColumnRenamed("node", "uid")
    per_rep = reps.select("same", "uid", "times").join(links, "uid", "left").join(component, "uid", "left")
    per_rep = per_rep.select("same", F.coalesce("component", "uid").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    owned = written(rows.select("id", "uid", "same").join(per_rep.hint("merge"), "same", "left").select("id", F.coalesce("component", "uid").alias("component"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "embed-owned")
    dropped(rows, reps, counted, component)
    smallest = owned.groupBy("component").agg(F.min("id").alias("component_id"))
    out = owned.join(smallest.hint("merge"), "component")
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table_of(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n
  FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.n > 0 AND b.n > 0
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach(node, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.seen = links.a),
c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

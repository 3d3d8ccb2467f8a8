"""Benchmark decontamination with an FM-index for each shard of the training documents.

Words: A-Z lower-cased, runs of letters, digits and non-ASCII characters. A window is ``width``
consecutive words of a benchmark item; a shorter item is one window of its own length. Each task builds
an index over shards of about ``SHARD_WORDS`` words of its documents, searches every window backwards
through it, locates the occurrences by sampled suffix positions, and merges the covered words to spans.
A longer document is cut into shards that overlap by ``width`` - 1 words, so a window is whole in one of
them. Documents don't move between tasks, so no key is hot, and a lost executor costs its tasks only.

The index has the benchmark's words as its alphabet; other words and the ends of documents are
separators, and one separator stands for several in a row, as no window has one inside.

The benchmark is sent to the tasks in blocks of about ``BLOCK_WINDOWS`` windows; further blocks are
further passes over the documents, each written to the shared folder. Only texts, and what earlier
passes found, go to Python; the other columns of a document stay where they are.

Defined results: null text has no words and no hits; null benchmark texts and item_ids are left out;
items with the same text all count, items with the same item_id count once; repeated documents each get
their row; without benchmark items nothing is hit; extra columns are left behind, or carried whole by
``without_contaminated``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinql.llm.common import arrow_column, dropped, fresh, quoted, released, table_of, written
from skeinql.llm.fm_index import FMIndex

WIDTH = 10
SHARD_WORDS = 250_000
BLOCK_WINDOWS = 400_000
PIECE_BYTES = 4 << 20
FOUND = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

#: Bytes that are no part of a word become spaces; A-Z become a-z. UTF-8 bytes from 0x80 are letters.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Benchmark:
    """The windows of a block of items: vocabulary, patterns by length, and the items of each window."""

    def __init__(self, items: Iterable[tuple[str, str]], width: int = WIDTH) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.width = width
        number: dict[str, int] = {}
        windows: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item_id, text in items:
            n = number.setdefault(item_id, len(number))
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32)
            if len(ids):
                size = min(width, len(ids))
                windows.setdefault(size, []).append((np.lib.stride_tricks.sliding_window_view(ids, size), n))
        self.item_ids = list(number)
        #: (patterns, their items one after another, where each pattern's items begin)
        self.patterns: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _, found in sorted(windows.items()):
            patterns, which = np.unique(np.concatenate([w for w, _ in found]), axis=0, return_inverse=True)
            owner = np.repeat([n for _, n in found], [len(w) for w, _ in found])
            pairs = np.unique(which.ravel().astype(np.int64) * len(number) + owner)
            of = pairs // len(number)
            self.patterns.append((patterns, pairs % len(number), np.searchsorted(of, np.arange(len(patterns) + 1))))

    def numbers(self, text: str | None) -> np.ndarray:
        """The words of a text by number, 0 for those that the benchmark doesn't have. A long text is split piece by piece."""
        if not text:
            return np.empty(0, np.int32)
        raw, out, at = text.encode("utf-8", "surrogatepass").translate(_TABLE), [], 0
        get = self.vocabulary.get
        while at < len(raw):
            end = len(raw) if len(raw) - at <= PIECE_BYTES else raw.find(b" ", at + PIECE_BYTES)
            end = len(raw) if end < 0 else end
            words = raw[at:end].split()
            out.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
            at = end
        return np.concatenate(out)


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges lo..hi, and of which range each is."""
    size = hi - lo
    of = np.repeat(np.arange(len(lo)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[of], of


class Found:
    """What was found in one document: words in all, spans (start, end) of hit words in the order found, items by number."""

    def __init__(self) -> None:
        self.words, self.spans, self.items = 0, [], set()


def scan_shard(parts: list[tuple[np.ndarray, int, Found]], bench: Benchmark) -> None:
    """Search the windows in an index over pieces (words by number, place of the first in its document, the document's result)."""
    full = np.concatenate([x for words, _, _ in parts for x in (words, np.zeros(1, np.int32))])
    begins = np.cumsum([0, *(len(words) + 1 for words, _, _ in parts)])[:-1]
    stays = full != 0
    stays[1:] |= full[:-1] != 0
    at = np.flatnonzero(stays)
    if not bench.patterns or not full.any():
        return
    index = FMIndex(full[at], len(bench.vocabulary))
    cover = np.zeros(len(full) + 1, np.int64)
    for patterns, items, starts in bench.patterns:
        lo, hi = index.search(patterns)
        rows, of = _spread(lo, hi)
        if not len(rows):
            continue
        where = at[index.locate(rows)]
        np.add.at(cover, where, 1)
        np.add.at(cover, where + patterns.shape[1], -1)
        # a window's items are spread once for each piece that has it, however often it occurs there
        once = np.unique((np.searchsorted(begins, where, "right") - 1) * len(patterns) + of)
        piece, pattern = once // len(patterns), once % len(patterns)
        for lo in range(0, len(once), 1 << 16):
            own = slice(lo, lo + (1 << 16))
            which, row = _spread(starts[pattern[own]], starts[pattern[own] + 1])
            for p in np.unique(piece[own][row] * len(bench.item_ids) + items[which]).tolist():
                parts[p // len(bench.item_ids)][2].items.add(p % len(bench.item_ids))
    hit = np.zeros(len(full) + 2, np.int8)
    hit[1:-1] = np.cumsum(cover)[:-1] > 0
    edges = np.diff(hit)
    spans = np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], axis=1)
    piece = np.searchsorted(begins, spans[:, 0], "right") - 1
    for k, (a, b) in zip(piece.tolist(), (spans - begins[piece, None]).tolist()):
        parts[k][2].spans.append((a + parts[k][1], b + parts[k][1]))


def scan(texts: Iterable[str | None], bench: Benchmark, shard_words: int = SHARD_WORDS) -> Iterator[Found]:
    """The result of each text, in order."""
    step = max(shard_words, 2 * bench.width)
    waiting: list[Found] = []
    parts: list[tuple[np.ndarray, int, Found]] = []
    size = 0
    for t in texts:
        one, words = Found(), bench.numbers(t)
        one.words = len(words)
        waiting.append(one)
        at = 0
        while at < len(words):
            piece = words[at : at + step]
            parts.append((piece, at, one))
            size += len(piece)
            if size >= step:
                scan_shard(parts, bench)
                parts, size = [], 0
            # the next piece begins with the words that a window may share with this one
            at = at + len(piece) if at + len(piece) >= len(words) else at + len(piece) - bench.width + 1
        if not parts:
            yield from waiting
            waiting = []
    if parts:
        scan_shard(parts, bench)
    yield from waiting


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in ascending order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def marked(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> tuple[DataFrame, str]:
    """docs with one more column, struct (n_words, spans, items), and that column's name."""
    spark, name, own = docs.sparkSession, fresh(docs, "found"), [quoted(c) for c in docs.columns]
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.regexp_count("t", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_windows))
    cur = docs.withColumn(name, F.lit(None).cast(FOUND))
    for k in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k)
        sent = spark.sparkContext.broadcast(Benchmark([(r.i, r.t) for r in block.toLocalIterator()], width))  # about BLOCK_WINDOWS windows

        def run(batches: Iterator[tuple[pa.Array, ...]], sent=sent) -> Iterator[pa.Array]:
            bench, before = sent.value, deque()

            def texts() -> Iterator[str | None]:
                for text, spans, items in batches:
                    for t, s, i in zip(text, spans, items):
                        before.append((s, i))
                        yield t.as_py()

            rows: list[tuple[int, list, list]] = []

            def done() -> pa.Array:
                n, spans, items = zip(*rows) if rows else ((), (), ())
                return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))], names=["n_words", "spans", "items"])

            for one in scan(texts(), bench):
                s, i = before.popleft()
                spans = merged(one.spans + [(x["start"], x["end"]) for x in s.as_py() or ()])
                rows.append((one.words, [{"start": a, "end": b} for a, b in spans], sorted({*(i.as_py() or ()), *(bench.item_ids[x] for x in one.items)})))
                if len(rows) >= 2000:
                    yield done()
                    rows = []
            yield done()
            released()

        found = arrow_column(run, FOUND, 3)(F.col(quoted(text_col)).cast("string"), F.col(name)["spans"], F.col(name)["items"])
        old, cur = cur, cur.select(*own, found.alias(name))
        if k < blocks - 1:
            cur = written(cur, "decontaminate")
            dropped(old)
    return cur, name


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(id_col, n_words, spans, items) of every document, in no given order.

    spans: merged ranges (start, end) of hit words, counted from 0; items: item_ids (as strings, sorted
    as such) of which some window occurs. benchmark: item_id, text.
    """
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    found, name = marked(narrow, benchmark, width, "_text", block_windows)
    return found.select(F.col("_id").alias(id_col), f"{name}.*")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their own columns."""
    found, name = marked(docs, benchmark, width)
    return found.where(F.size(F.col(name)["spans"]) == 0).select([quoted(c) for c in docs.columns])


def excised(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of some spans and what stands between these words."""
    raw = text.encode("utf-8", "surrogatepass")
    is_word = np.frombuffer(raw.translate(_TABLE), np.uint8) != 32
    edges = np.diff(np.concatenate([[0], is_word.astype(np.int8), [0]]))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : begins[a]])
        at = ends[b - 1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table_of(spark, sf_dir, "documents"), table_of(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, len(w[i:i + 9]) AS size, array_to_string(w[i:i + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM bw WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, row_number() OVER () AS uid, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
sizes AS (SELECT DISTINCT size FROM win),
dg AS (
  SELECT uid, i, size, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT uid, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM dw, sizes WHERE len(w) >= size)),
hits AS (SELECT dg.uid, dg.i, dg.size, win.item_id FROM dg JOIN win ON dg.g = win.g AND dg.size = win.size),
n_hit AS (SELECT uid, count(DISTINCT p) AS n FROM (SELECT uid, unnest(generate_series(i, i + size - 1)) AS p FROM hits) GROUP BY uid),
items AS (SELECT uid, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT uid, item_id FROM hits) GROUP BY uid)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, coalesce(n_hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(n_hit.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN n_hit USING (uid) LEFT JOIN items USING (uid)
"""

"""Near-duplicate documents: DartMinHash signatures of word shingles, banded, verified, joined to classes.

1. A document's elements are its runs of five words (lower-cased, split at white space; fewer words are
   one run), weighted by how often they occur. Texts with the same words collapse to one representative.
2. Signatures of 120 coordinates in 24 bands of 5: a pair of similarity 0.8 shares a band with
   probability 0.99993, one of 0.85 or more with 0.9999998. Only documents that share a band's key go on.
3. The members of a bucket are rows that carry their elements, and they are compared exactly (weighted
   Jaccard >= 0.8) in one task. A task returns which components its links join, at most as many rows as it
   has members; pairs of documents never leave it. The first ``FIRST_BANDS`` bands go first: of the other
   bands only buckets that still hold several components are looked at.
4. A bucket of more than ``GROUP`` members, or of very long texts, is first dealt into overlapping tiles,
   which joins most of it. Then every member outside of the bucket's largest component is compared with all
   its members, block by block, each two blocks in a task of their own. So each pair that shares a bucket and
   isn't already in one component is compared exactly; no estimate, cap or sample decides.

An element that occurs w times counts as w elements (element, 0) ... (element, w - 1), which makes weighted
Jaccard that of plain sets; in larger groups all intersections are one product of 0/1 matrices.

Defined results: one row for each input row. Null or wordless texts and null ids link with nothing; rows
with one doc_id are one document (they share a class, which has the links of all their texts); the class is
the smallest doc_id in it; of a class the document with that id is kept; an empty table gives an empty
result; extra columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinql.llm.common import BROADCAST_KEYS, bounded, connected_components, dropped, labels_of, quoted, released, table_of, written
from skeinql.llm.dart_minhash import mix, signatures

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
K = BANDS * ROWS
FIRST_BANDS = 4
#: A group that is compared as a whole has at most so many members, and elements in all, unless one text alone has more.
GROUP = 512
GROUP_ELEMENTS = 4 << 20
#: Groups of up to so many members are compared pair by pair.
FEW = 12
COLUMNS = 4096
CACHE_WORDS = 100_000
BATCH_WORDS, BATCH_DOCS = 150_000, 400


class _Words(dict):
    """Word -> 64-bit hash; a bounded cache."""

    def __missing__(self, word: str) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def word_hashes(text: str | None) -> np.ndarray:
    words = text.lower().split() if text else []
    if len(_words) > CACHE_WORDS:
        _words.clear()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def shingles(parts: list[np.ndarray], size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, element, weight): the distinct runs of each document's words with their counts, by document and element."""
    n = np.array([len(p) for p in parts], np.int64)
    if not n.sum():
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0)
    words = np.concatenate([*parts, np.zeros(size, np.uint64)])
    doc = np.repeat(np.arange(len(parts)), n)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    run = np.zeros(len(doc), np.uint64)
    short = n[doc] < size
    for j in range(size):
        w = words[j : j + len(doc)]
        run = run * np.uint64(0x9E3779B97F4A7C15) + np.where(short & (place + j >= n[doc]), np.uint64(j + 1), mix(w))
    starts = np.where(short, place == 0, place <= n[doc] - size)
    doc, run = doc[starts], mix(run[starts])
    order = np.argsort(run)
    order = order[np.argsort(doc[order].astype(np.uint16) if len(parts) < 65536 else doc[order], kind="stable")]
    doc, run = doc[order], run[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new)
    return doc[heads], run[heads], np.diff(np.append(heads, len(run))).astype(np.float64)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """documents x bands keys (int64); a key says its band as well."""
    out = np.empty((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sig), b + 1, np.uint64)
        for c in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * ROWS + c])
        out[:, b] = key
    return out.view(np.int64)


def unweighted(of: np.ndarray, element: np.ndarray, weight: np.ndarray, sets: int) -> list[np.ndarray]:
    """For each set its elements, one for each unit of weight, ascending."""
    times = weight.astype(np.int64)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    of, unit = np.repeat(of, times), np.repeat(element, times)
    more = nth > 0
    unit[more] = mix(unit[more] + nth[more].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    order = np.lexsort((unit, of))
    return np.split(unit[order], np.searchsorted(of[order], np.arange(1, sets)))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 0.0


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, code, same, size, bands) of every document that has words; code: hash of its text, same: of all its words in order, size: its elements."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    src = src.select("id", F.xxhash64("text").alias("code"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def done(ids: list[int], codes: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
            of, element, weight = shingles(parts)
            keys = band_keys(signatures(of, element, weight, len(parts), K))
            same = [xxhash.xxh3_128_digest(p.tobytes()) for p in parts]
            size = np.bincount(of, weight, len(parts)).astype(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(ids) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(codes, pa.int64()), pa.array(same, pa.binary()), pa.array(size), bands], names=["id", "code", "same", "size", "bands"])

        ids, codes, parts, size = [], [], [], 0
        for batch in batches:
            for i, code, text in zip(*map(batch.column, ("id", "code", "text"))):
                p = word_hashes(text.as_py())
                if not len(p):
                    continue
                ids.append(i.as_py())
                codes.append(code.as_py())
                parts.append(p)
                size += len(p)
                if size >= BATCH_WORDS or len(ids) >= BATCH_DOCS:
                    yield done(ids, codes, parts)
                    ids, codes, parts, size = [], [], [], 0
        if ids:
            yield done(ids, codes, parts)
        _words.clear()
        released()

    return src.mapInArrow(run, "id long, code long, same binary, size long, bands array<long>")


def _buckets(reps: DataFrame) -> DataFrame:
    """(key, band, id, doc, size, n, total): the representatives of each bucket of n > 1 members, total elements in all."""
    rows = reps.select("id", "doc", "size", F.posexplode("bands").alias("band", "key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total")).where("n > 1")
    return rows.join(sizes.hint("merge"), "key").select("key", "band", "id", "doc", "size", "n", "total")


def _elements(buckets: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, elements) of the members of buckets: little-endian 64-bit integers, ascending."""
    members = written(buckets.select("doc", "id").distinct(), "near-members")
    text = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    text = text.select("doc", F.xxhash64("text").alias("id"), "text").join(bounded(members), ["doc", "id"], "left_semi").dropDuplicates(["doc", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(ids: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
            found = unweighted(*shingles(parts), len(parts))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x.astype("<u8").tobytes() for x in found], pa.binary())], names=["id", "elements"])

        ids, parts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column("id"), batch.column("text")):
                ids.append(i.as_py())
                parts.append(word_hashes(t.as_py()))
                size += len(parts[-1])
                if size >= BATCH_WORDS or len(ids) >= BATCH_DOCS:
                    yield done(ids, parts)
                    ids, parts, size = [], [], 0
        if ids:
            yield done(ids, parts)
        _words.clear()
        released()

    out = written(text.select("id", "text").mapInArrow(run, "id long, elements binary"), "near-elements")
    dropped(members)
    return out


def _several(rows: DataFrame) -> DataFrame:
    """The rows of keys that hold several components."""
    several = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    return rows.join(several.hint("merge"), "key")


def _with_component(buckets: DataFrame, component: DataFrame | None) -> DataFrame:
    """Buckets with each member's component, where these are several."""
    if component is None:
        return buckets.withColumn("component", F.col("doc"))
    near = bounded(component.withColumnRenamed("node", "doc"))
    return _several(buckets.join(near, "doc", "left").withColumn("component", F.coalesce("component", "doc")))


def _cuts(n: str, total: str, group: int) -> F.Column:
    """In how many pieces of half a group's members and elements something is cut."""
    return F.greatest(F.ceil(F.col(n) / F.lit(group // 2)), F.ceil(F.col(total) / F.lit(GROUP_ELEMENTS // 2))).cast("int")


def _tiles(rows: DataFrame, group: int) -> DataFrame:
    """(key, id, component, side): whole buckets; of large ones tiles, each member in two neighbouring ones of them."""
    tiles = _cuts("n", "total", group)
    tile = F.pmod(F.xxhash64("id", "key"), tiles).cast("int")
    near = F.when(tiles <= 2, F.array(F.lit(-1))).otherwise(F.array(tile, F.pmod(tile + 1, tiles)))
    out = rows.select("id", "component", F.explode(near).alias("tile"), "key")
    return _several(out.select(F.when(F.col("tile") < 0, F.col("key")).otherwise(F.xxhash64("key", "tile")).alias("key"), "id", "component", F.lit(-1).alias("side")))


def _blocks(rows: DataFrame, group: int) -> DataFrame:
    """(key, id, component, side): the members of large buckets that aren't in the largest component of theirs (side 0), block by block against all members (side 1)."""
    large = rows.where(_cuts("n", "total", group) > 2)
    parts = large.groupBy("key", "component").agg(F.count("*").alias("m"), F.sum("size").alias("s"))
    most = parts.groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("most"), (F.sum("m") - F.max("m")).alias("rest"), F.sum("s").alias("all"))
    both = large.join(most.hint("merge"), "key").withColumn("minor", F.col("component") != F.col("most"))
    both = both.withColumns({"right": _cuts("n", "total", group), "left": _cuts("rest", "all", group)})
    left = both.where("minor").select("key", "id", "component", F.lit(0).alias("side"), F.pmod(F.xxhash64("id", "key"), "left").alias("l"), F.explode(F.sequence(F.lit(0), F.col("right") - 1)).alias("r"))
    right = both.select("key", "id", "component", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("left") - 1)).alias("l"), F.pmod(F.xxhash64("key", "id"), "right").alias("r"))
    return left.unionByName(right).select(F.xxhash64("key", "l", "r").alias("key"), "id", "component", "side")


def _links_of(own: np.ndarray, side: np.ndarray, sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): which components the links between members of one group join, as a forest. Sides 0 and 1 are compared with each other."""
    of, node = np.unique(own, return_inverse=True)
    root = list(range(len(of)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(i: int, j: int) -> None:
        x, y = top(node[i]), top(node[j])
        root[max(x, y)] = min(x, y)

    size = np.array([len(s) for s in sets])
    if len(sets) <= FEW:
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                if (side[i] < 0 or side[i] != side[j]) and top(node[i]) != top(node[j]) and min(size[i], size[j]) >= threshold * max(size[i], size[j]) and similarity(sets[i], sets[j]) >= threshold:
                    join(i, j)
    else:
        a, b = (np.arange(len(sets)),) * 2 if side[0] < 0 else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        common = _intersections(sets, size, a, b)
        linked = (common >= threshold * (size[a][:, None] + size[b][None, :] - common)) & (node[a][:, None] != node[b][None, :])
        i, j = np.nonzero(linked)
        root = labels_of(len(of), node[a[i]], node[b[j]]).tolist()
    new = np.array([top(x) for x in range(len(of))])
    moved = np.flatnonzero(new != np.arange(len(of)))
    return of[moved], of[new[moved]]


def _intersections(sets: list[np.ndarray], size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common elements of each set in a with each in b, by products of 0/1 matrices of the elements that several sets have."""
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(sets)), size), times[column] > 1
    number = np.cumsum(times > 1) - 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        x, y = np.searchsorted(column, [lo, lo + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[row[x:y], column[x:y] - lo] = 1
        common += has[a] @ has[b].T
    return common.astype(np.float64)


def _joined(groups: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """(a, b): components that links within groups join; groups: key, id, component, side."""
    rows = groups.join(elements.hint("merge"), "id").select("key", "component", "side", "elements").repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, side = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("component", "side"))
            sets = [np.frombuffer(x.as_buffer(), "<u8") for b in held for x in b.column("elements")]
            x, y = _links_of(own, side, sets, threshold)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column("key").to_numpy()
            edges = np.flatnonzero(key[1:] != key[:-1]) + 1
            for lo, hi in zip([0, *edges], [*edges, len(key)]):
                if held and held[0].column("key")[0].as_py() != key[lo]:
                    yield from found(held)
                    held = []
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield from found(held)
        released()

    return rows.mapInArrow(run, "a long, b long")


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """(id_col, class_id, kept) for each row of docs. group: members of a group that is compared as a whole."""
    signed = written(sign(docs, id_col, text_col), "near-signed")
    first = F.min(F.struct("id", "code", "size", "bands"))
    # texts are known by their codes, as rows with one doc_id may have several; components are of doc_ids
    reps = written(signed.groupBy("same").agg(first.alias("m")).select("same", F.col("m.id").alias("doc"), F.col("m.code").alias("id"), "m.size", "m.bands"), "near-reps")
    to_doc = written(signed.select("id", "same").join(reps.select("same", "doc").hint("merge"), "same").select("id", "doc"), "near-docs")
    dropped(signed)
    several = to_doc.groupBy("id").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).where("a < z").select("id", "a")
    links = written(to_doc.join(several, "id").select("a", F.col("doc").alias("b")).distinct(), "near-links")
    buckets = written(_buckets(reps), "near-buckets")
    dropped(reps)
    elements = _elements(buckets, docs, id_col, text_col)
    component = None
    for cut, want in ((_tiles, F.col("band") < FIRST_BANDS), (_tiles, F.col("band") >= FIRST_BANDS), (_blocks, F.lit(True))):
        groups = written(cut(_with_component(buckets.where(want), component), group), "near-groups")
        more = written(_joined(groups, elements, threshold).distinct(), "near-links")
        old_links, old = links, component
        links = written(links.union(more), "near-links")
        component = connected_components(links, "near-components") if old is None or not more.isEmpty() else old
        dropped(groups, more, old_links, *([old] if old is not None and old is not component else []))
    dropped(buckets, elements, links)
    classes = to_doc.join(bounded(component.withColumnRenamed("node", "doc")), "doc", "left").select("id", F.coalesce("component", "doc").alias("class_id"))
    # rows with one id: one class
    classes = written(classes.groupBy("id").agg(F.min("class_id").alias("class_id")), "near-classes")
    dropped(to_doc, component)
    out = docs.select(F.col(id_col).alias(id_col), F.col(id_col).cast("long").alias("id")).join(classes, "id", "left")
    class_id = F.coalesce("class_id", "id")
    return out.select(id_col, class_id.alias("class_id"), F.coalesce(class_id == F.col("id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, with its own columns; of rows with one doc_id that with the smallest hash stays, null ids all stay."""
    found = near_duplicate_classes(docs, threshold)
    gone = written(found.where("NOT kept").select("doc_id").distinct(), "near-gone")
    again = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "near-again")
    own = [quoted(c) for c in docs.columns]
    stay = docs.join(bounded(gone), "doc_id", "left_anti").select(own)
    if again.isEmpty():
        return stay
    repeated = stay.join(bounded(again), "doc_id", "left_semi").select("doc_id", F.struct(*own).alias("_row"))
    one = repeated.groupBy("doc_id").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row")).select("_row.*")
    return stay.join(bounded(again), "doc_id", "left_anti").select(own).unionByName(one.select(own))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table_of(spark, sf_dir, "documents"))

"""Token ids as Parquet list columns, in ascending doc_id order, with selective reads.

Documents are dealt out by ranges of doc_id and sorted within; each task encodes its range and Spark's
Parquet writer commits its file: a list<int> column of ids next to narrow columns (doc_id, n_tokens,
start within the part, part). Version-2 pages give dictionary encoding with a delta-packed fallback;
row groups and pages have fixed sizes, and page indexes let a reader of a doc_id range, or of the narrow
columns only, skip the ids. A part's first token number is the sum of the parts before it, which comes
from the narrow columns: no ids are read and nothing is counted twice.

Encoding is by white-space separated chunks with a bounded cache of what the tokenizer gave for each:
the tokenizer's own rules (composition, lower case, pieces that never hold white space) keep chunks apart.

Defined results: a null text is empty (its ids are the end id alone); null doc_ids sort first; rows with
one doc_id are all written, in order of their text's hash; an empty table gives empty files; extra
columns are left behind.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinql.llm.common import BROADCAST_KEYS, released, scratch_path, small_batches, table_of

END_ID = 1
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
DICTIONARY_BYTES = 1 << 20
#: Chunks in each of the two generations of the cache.
CACHE_CHUNKS = 200_000
#: Texts encoded at once.
TEXTS = 2048

SCHEMA = "doc_id long, part int, start_in_part long, n_tokens int, ids array<int>"


class ChunkEncoder:
    """Encodes with a `tokenizers` file whose pieces never span white space; keeps what it has seen."""

    _own: dict[str, "ChunkEncoder"] = {}  # one for each Python worker, over its tasks

    #: Texts with none of these are composed as they stand, and lower case changes them character by character.
    _OTHER = re.compile("[^\x00-\u012F\u0131-\u024F]")
    #: Punctuation after a letter or digit begins a piece of its own, so a space may stand before it.
    _MARKS = re.compile(r"([!-/:-@\[-`{-~])(?<=[^\W_].)")
    #: One piece as it stands, whose bytes the model alone encodes.
    _PLAIN = re.compile("[a-zß-öø-ÿ]+")
    #: How the model writes the bytes of letters beyond ASCII: those of printable Latin-1 characters as these.
    _BYTES = {c: "".join(chr(b) if 161 <= b <= 172 or b >= 174 else chr(256 + 33 + b - 126 - 1 if b < 161 else 256 + 67) for b in chr(c).encode()) for c in range(0xDF, 0x100)}
    #: Stands between chunks that are encoded in one call; a piece of its own.
    _BETWEEN = ","

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS) -> None:
        from tokenizers import Tokenizer

        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are written as little-endian 32-bit integers")
        self.tokenizer, self.cache_chunks = Tokenizer.from_file(path), cache_chunks
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.between = self._one(self._BETWEEN)

    @classmethod
    def of(cls, path: str, cache_chunks: int = CACHE_CHUNKS) -> "ChunkEncoder":
        if path not in cls._own:
            cls._own[path] = cls(path)
        cls._own[path].cache_chunks = cache_chunks
        return cls._own[path]

    def _one(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _fill(self, chunks: list[str]) -> None:
        """Learn the ids of new chunks, most of them in one call of the tokenizer."""
        rest = []
        tokenize, seen, older, plain, written = self.tokenizer.model.tokenize, self.seen, self.older.get, self._PLAIN.fullmatch, self._BYTES
        for c in chunks:
            ids = older(c)
            if ids is not None:
                seen[c] = ids
            elif plain(c):
                seen[c] = array("I", [t.id for t in tokenize(c if c.isascii() else c.translate(written))]).tobytes()
            else:
                rest.append(c)
        joined = [c for c in rest if c and self._BETWEEN not in c and "<|" not in c]
        if joined:
            ids = np.array(self.tokenizer.encode_batch_fast([f" {self._BETWEEN} ".join(joined)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == np.frombuffer(self.between, "<u4")[0])
            starts, ends, raw = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], ids.tobytes()
            for c, a, b in zip(joined, starts, ends, strict=True):
                self.seen[c] = raw[4 * a : 4 * b]
        for c in set(rest).difference(joined):
            self.seen[c] = self._one(c)

    def _spaced(self, text: str | None) -> str:
        """The text with spaces alone between its chunks."""
        if not text:
            return ""
        if "<|" not in text and (text.isascii() or not self._OTHER.search(text)):
            text = self._MARKS.sub(r" \1", text.lower())
        return text.replace("\n", " ")

    def encode_all(self, texts: list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts as unsigned 32-bit integers, and where those of each end; end_id is put after each.

        Each different chunk is looked up once, what is new in all texts is learnt at once, and ids are copied by position.
        """
        words = pc.split_pattern(pa.array([self._spaced(t) for t in texts], pa.large_string()), " ")
        coded = words.flatten().dictionary_encode()
        chunks, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.seen) > self.cache_chunks:
            self.seen, self.older = {}, self.seen
        self._fill([c for c in chunks if c not in self.seen])
        known = list(map(self.seen.__getitem__, chunks))
        # ids of chunks, then the end id, which stands after each text as if it were a chunk
        known.append(b"" if end_id is None else np.array([end_id], "<u4").tobytes())
        length = np.fromiter(map(len, known), np.int64, len(known)) // 4
        start = np.cumsum(length) - length
        last = words.offsets.to_numpy()[1:]
        at = np.insert(at, last, len(chunks))
        n = length.astype(np.int32)[at]
        ends = np.cumsum(n, dtype=np.int64)
        kind = np.int32 if len(at) and max(ends[-1], start[-1]) < 1 << 31 else np.int64  # of half the memory, where it does
        places = np.repeat(start.astype(kind)[at] - (ends - n).astype(kind), n)
        places += np.arange(len(places), dtype=kind)
        return np.frombuffer(b"".join(known), "<u4")[places], ends[last + np.arange(len(last))]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0].tobytes()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, cache_chunks: int = CACHE_CHUNKS) -> DataFrame:
    """Encode and write the documents to a folder; gives the table read back from the files."""
    spark, file = docs.sparkSession, tokenizer or default_tokenizer()
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # beside doc_id, so that rows with one doc_id can be dealt out as well
    src = src.withColumns({"h": F.xxhash64("text"), "uid": F.monotonically_increasing_id()})
    keys = [F.col("doc_id").asc_nulls_first(), "h", "uid"]
    dealt = src.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        encoder = ChunkEncoder.of(file, cache_chunks)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):  # so that ids of a few texts are held at a time
                piece = batch.slice(at, TEXTS)
                ids, ends = encoder.encode_all(piece.column("text").to_pylist(), end_id)
                n = np.diff(ends, prepend=0).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(start + ends - n), pa.array(n), lists],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )
                start += int(ends[-1])
        released()

    out = dealt.mapInArrow(encode, SCHEMA)
    options = {
        "compression": "zstd",
        "parquet.writer.version": "v2",
        "parquet.enable.dictionary": "true",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.dictionary.page.size": str(DICTIONARY_BYTES),
    }
    with small_batches(spark):
        out.write.options(**options).parquet(path)
    return read_tokens(spark, path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The table as written. Filters on doc_id skip row groups and pages; unused columns aren't read."""
    return spark.read.schema(SCHEMA).parquet(path)


def token_index(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens) of each document, of the narrow columns alone."""
    start = (F.col("base") + F.col("start_in_part")).alias("start")
    return tokens.join(_bases(tokens), "part").select("doc_id", start, F.col("n_tokens").cast("long").alias("n_tokens"))


def _bases(tokens: DataFrame) -> DataFrame:
    """(part, base): the tokens before each part. A row for each file that was written, so it can be broadcast."""
    totals = tokens.groupBy("part").agg(F.max(F.col("start_in_part") + F.col("n_tokens")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # partitions of a shuffle are bounded by its setting
    small = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")) <= BROADCAST_KEYS
    return F.broadcast(base) if small else base


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, of the ids in the files."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            raw, first = memoryview(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B"), int(offsets[0])
            at = [4 * (o - first) for o in offsets.tolist()]
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])]
            n = np.diff(offsets).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "start_in_part")), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    narrow = tokens.select("doc_id", "part", "start_in_part", "ids").mapInArrow(sums, "doc_id long, part int, start_in_part long, n_tokens int, ids_crc32 long")
    return narrow.join(_bases(tokens), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(write_tokens(table_of(spark, sf_dir, "documents"), scratch_path(spark, "tokens")))

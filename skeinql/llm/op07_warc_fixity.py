"""WARC records and a Merkle fixity audit of two replicas.

Every record is hashed (SHA-256 of its bytes). Records are laid out in files of about ``FILE_RECORDS``: a file
is a prefix of the MD5 of a record's key, and within it records follow each other in the order of (MD5, key,
digest), so each has a byte offset. A replica's tree is over ordered offset ranges: a leaf is a range of
``RANGE_BYTES`` of a file and hashes, in the order of their offsets, the offset, length and digest of the
records that begin in it; an inner node hashes its up to 16 children in order; above the files' roots the tree
goes on to one root. The audit compares the roots and descends only below nodes that differ, down to offset
ranges, and compares records only in these.

A lost, added or longer record shifts the offsets after it, so the rest of its file differs as ranges; the
records there are then compared by key and digest, and those that only moved are intact. As files are
small, a shift costs one file.

Defined results: a null key is a key of its own; null url or html are empty; identical records are one entry
with their multiplicity (``copies``) and take that many times their length; a key whose records differ is
'corrupt', one that only the first or second replica has 'missing' or 'extra'; empty tables give empty
results; extra columns are left behind.
"""

from __future__ import annotations

import gzip
import io
import math
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinql.llm.common import bounded, dropped, table_of, written

FILE_RECORDS = 4096
RANGE_BYTES = 1 << 16
DATE = "2024-01-01T00:00:00Z"
BATCH_BYTES = 16 << 20


def warc_record(key: Column, uri: Column, payload: Column, date: str = DATE) -> Column:
    """The bytes of a WARC/1.0 response record; its id is the MD5 of the key in the form of a UUID."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    body = F.coalesce(payload.cast("string"), F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(">\r\nWARC-Target-URI: "), F.coalesce(uri.cast("string"), F.lit("")),
        F.lit(f"\r\nWARC-Date: {date}\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def file_digits(records: int) -> int:
    """Hexadecimal digits of a file's name for so many records."""
    return max(0, math.ceil(math.log(max(1, records / FILE_RECORDS), 16)))


def _known(key: Column) -> Column:
    """A non-null name for a key, null's own among them."""
    return F.coalesce(F.concat(F.lit("="), key), F.lit(""))


def entries(records: DataFrame) -> DataFrame:
    """(key, k, h, digest, length, copies) of the distinct records; records: key, record (binary)."""
    own = records.select(F.col("key").cast("string").alias("key"), F.sha2("record", 256).alias("digest"), F.octet_length("record").cast("long").alias("length"))
    one = own.groupBy("key", "digest", "length").agg(F.count("*").alias("copies"))
    return one.withColumn("k", _known(F.col("key"))).withColumn("h", F.md5(F.col("k").cast("binary")))


def manifest(records: DataFrame, digits: int) -> DataFrame:
    """entries() with each record's file and offset.

    Offsets are added up in two steps, by cells of a key (256, by digest) and within them, so that neither a
    file nor a key with many different records is sorted in one task record by record.
    """
    own = records.withColumns({"file": F.substring("h", 1, digits) if digits else F.lit(""), "cell": F.substring("digest", 1, 2), "size": F.col("length") * F.col("copies")})
    cells = own.groupBy("file", "h", "k", "cell").agg(F.sum("size").alias("size"))
    before = Window.partitionBy("file").orderBy("h", "k", "cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("k", "cell", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("k", "cell").orderBy("digest", "length").rowsBetween(Window.unboundedPreceding, -1)
    return own.join(starts.hint("merge"), ["k", "cell"]).withColumn("offset", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))).select("key", "k", "file", "offset", "length", "copies", "digest")


def levels_for(largest_offset: int) -> int:
    """Levels below a file's root for files of up to so many bytes."""
    return max(0, math.ceil(math.log(max(1, (largest_offset + 1) / RANGE_BYTES), 16)))


def _node(file: Column, offset: Column, digits: int, levels: int) -> Column:
    """The number of the leaf that an offset of a file is in; each four bits off it give the node above."""
    of_file = F.conv(file, 16, 10).cast("long") if digits else F.lit(0).cast("long")
    return F.shiftleft(of_file, 4 * levels) + F.floor(offset / F.lit(RANGE_BYTES))


def _hashed(rows: DataFrame, order: str, text: Column) -> DataFrame:
    """(node, digest): of each node the hash of its rows' texts in ascending order."""
    parts = F.array_sort(F.collect_list(F.struct(order, text.alias("text"))))
    return rows.groupBy("node").agg(F.sha2(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").cast("binary"), 256).alias("digest"))


def leaf_ranges(listed: DataFrame, digits: int, levels: int) -> DataFrame:
    """(node, digest) of each offset range that records begin in."""
    rows = listed.withColumn("node", _node(F.col("file"), F.col("offset"), digits, levels))
    return _hashed(rows, "offset", F.concat_ws(" ", "offset", "length", "copies", "k", "digest"))


def parents(nodes: DataFrame) -> DataFrame:
    """(node, digest) of the nodes one level up, which have 16 children at most."""
    rows = nodes.select(F.col("node").alias("child"), "digest", F.shiftrightunsigned("node", 4).alias("node"))
    return _hashed(rows, "child", F.concat_ws(" ", "child", "digest"))


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes that have not the same digest in both."""
    both = a.join(b.withColumnRenamed("digest", "other"), "node", "full")
    return both.where("NOT (digest <=> other)").select("node")


def differing_ranges(a: DataFrame, b: DataFrame, digits: int) -> tuple[DataFrame, int]:
    """(node) of the offset ranges in which two manifests differ, from the root down and below differing nodes only; and the levels below a file."""
    top = max(x.agg(F.coalesce(F.max("offset"), F.lit(0))).first()[0] for x in (a, b))
    levels = levels_for(top)
    trees = []
    for listed in (a, b):
        tree = [written(leaf_ranges(listed, digits, levels), "fixity-nodes")]
        for _ in range(levels + digits):
            tree.append(written(parents(tree[-1]), "fixity-nodes"))
        trees.append(tree[::-1])
    found = written(_differing(trees[0][0], trees[1][0]), "fixity-differ")
    for x, y in zip(trees[0][1:], trees[1][1:]):
        near = bounded(found.withColumnRenamed("node", "up"))
        under = [t.withColumn("up", F.shiftrightunsigned("node", 4)).join(near, "up", "left_semi").drop("up") for t in (x, y)]
        lower = written(_differing(*under), "fixity-differ")
        dropped(found)
        found = lower
    dropped(*trees[0], *trees[1])
    return found, levels


def _manifests(primary: DataFrame, replica: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    own = [written(entries(x), "fixity-entries") for x in (primary, replica)]
    digits = file_digits(max(x.count() for x in own))
    a, b = (written(manifest(x, digits), "fixity-manifest") for x in own)
    dropped(*own)
    return a, b, digits


def damaged_ranges(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(file, offset, length) of the offset ranges in which the replicas differ."""
    a, b, digits = _manifests(primary, replica)
    found, levels = differing_ranges(a, b, digits)
    dropped(a, b)
    file = F.lower(F.lpad(F.conv(F.shiftrightunsigned("node", 4 * levels).cast("string"), 10, 16), digits, "0")) if digits else F.lit("")
    within = F.col("node") - F.shiftleft(F.shiftrightunsigned("node", 4 * levels), 4 * levels)
    return found.select(file.alias("file"), (within * F.lit(RANGE_BYTES)).alias("offset"), F.lit(RANGE_BYTES).cast("long").alias("length"))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(key, file, offset, length, copies, digest, range_differs, status) of every distinct record of the primary, and of the replica's extra keys.

    offset: where the record begins in its file, of an extra one in the replica's. range_differs: whether
    the offset range in which it begins has another hash in the replica.
    """
    a, b, digits = _manifests(primary, replica)
    ranges, levels = differing_ranges(a, b, digits)
    node, near = _node(F.col("file"), F.col("offset"), digits, levels), bounded(ranges)
    placed = [x.withColumn("node", node).join(near.withColumn("range_differs", F.lit(True)), "node", "left").withColumn("range_differs", F.coalesce("range_differs", F.lit(False))) for x in (a, b)]
    # what isn't the same in both is in differing ranges of both
    suspects = [x.where("range_differs") for x in placed]
    same = suspects[0].select("k", "digest", "copies").join(suspects[1].select("k", "digest", F.col("copies").alias("other")), ["k", "digest"], "full")
    # of the keys in differing ranges, those that have not the same records, and which replica has them
    verdict = same.groupBy("k").agg(F.bool_and(F.col("copies").eqNullSafe(F.col("other"))).alias("intact"), F.count("copies").alias("x"), F.count("other").alias("y"))
    verdict = verdict.where("NOT intact").select("k", F.when(F.col("y") == 0, "missing").when(F.col("x") == 0, "extra").otherwise("corrupt").alias("status"))
    verdict = bounded(written(verdict, "fixity-verdict"))
    columns = ["key", "file", "offset", "length", "copies", "digest", "range_differs", "status"]
    judged = placed[0].join(verdict, "k", "left").withColumn("status", F.coalesce("status", F.lit("intact"))).select(columns)
    return judged.unionByName(placed[1].join(verdict.where("status = 'extra'"), "k").select(columns))


def _line(f: BinaryIO) -> tuple[bytes, bool]:
    """(line, whether the file ends or breaks off here)."""
    try:
        line = f.readline()
        return line, not line
    except (EOFError, zlib.error, gzip.BadGzipFile):
        return b"", True


def parse_warc(f: BinaryIO) -> Iterator[tuple[int, int, dict[str, str], bytes, bool]]:
    """(offset, length, headers, content, whole) of each record of a plain stream.

    A record that breaks off, has no usable Content-Length or one that doesn't end at the next record is not
    whole; reading goes on at the next line that begins a record.
    """
    line, over = _line(f)
    at = 0  # of the line in hand
    while not over:
        if not line.startswith(b"WARC/"):
            at += len(line)
            line, over = _line(f)
            continue
        start, at = at, at + len(line)
        headers: dict[str, str] = {}
        while True:
            line, over = _line(f)
            at += len(line)
            if over or not line.strip():
                break
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = headers.get("content-length", "")
        want = int(size) if size.isascii() and size.isdigit() else None
        found = bytearray()
        while want is not None and len(found) < want:
            try:
                more = f.read(min(want - len(found), 1 << 20))
            except (EOFError, zlib.error, gzip.BadGzipFile):
                more = b""
            if not more:
                break
            found += more
        content = bytes(found)
        at += len(content)
        whole = want is not None and len(content) == want
        end, blank = at, b""
        while True:
            line, over = _line(f)
            if over or line.strip() or len(blank) >= 4:
                break
            blank += line
            at += len(line)
        whole &= blank == b"\r\n\r\n" and (over or line.startswith(b"WARC/"))
        yield start, (at if blank else end) - start, headers, content, whole


def opened(data: bytes) -> BinaryIO:
    """A file's bytes as a plain stream; gzipped members are unpacked one after another, never all at once."""
    return gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, type, uri, date, record_id, content, whole) of the records of WARC files, one task a file.

    Offsets are of the plain bytes. A file is read through Spark, so it has 2 GB at most as it is stored; it
    is unpacked record by record. An empty file has no records; see parse_warc for damaged ones.
    """
    fields = [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("record_id", pa.string()), ("content", pa.binary()), ("whole", pa.bool_())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column("path"), batch.column("content")):
                rows, size = [], 0
                for o, n, h, content, whole in parse_warc(opened(data.as_py())):
                    rows.append((file.as_py(), o, n, h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-record-id"), content, whole))
                    size += len(content)
                    if size > BATCH_BYTES or len(rows) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, offset long, length long, type string, uri string, date string, record_id string, content binary, whole boolean")


def page_records(pages: DataFrame, html: Column | None = None) -> DataFrame:
    """(key, record) of a table of pages (page_id, url, html)."""
    return pages.select(F.col("page_id").alias("key"), warc_record(F.col("page_id"), F.col("url"), F.col("html") if html is None else html).alias("record"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the pages' records against a replica with damage at known places: of page_ids that leave 7 by 101 the
    record has another last byte, of those that leave 11 a byte more, those that leave 13 are missing, and those that
    leave 19 are there under another id as well."""
    pages = table_of(spark, sf_dir, "pages").select("page_id", "url", "html")
    mark = F.coalesce(F.pmod("page_id", F.lit(101)), F.lit(0))
    html = F.coalesce("html", F.lit(""))
    html = F.when(mark == 7, F.concat(F.expr("left(coalesce(html, ''), greatest(length(html) - 1, 0))"), F.lit("~"))).when(mark == 11, F.concat(html, F.lit("~"))).otherwise(html)
    twice = pages.where(mark == 19).withColumn("page_id", -F.col("page_id") - 1)
    replica = page_records(pages.where(mark != 13), html).unionByName(page_records(twice))
    found = audit(page_records(pages), replica)
    return found.select(F.col("key").cast("long").alias("page_id"), "file", "offset", "length", "copies", F.col("digest").alias("record_sha256"), "range_differs", "status")


ORACLE = r"""
WITH p AS (
  SELECT 'a' AS side, page_id, url, coalesce(html, '') AS h FROM pages
  UNION ALL SELECT 'b', page_id, url, CASE page_id % 101 WHEN 7 THEN left(coalesce(html, ''), greatest(coalesce(length(html), 0) - 1, 0)) || '~' WHEN 11 THEN coalesce(html, '') || '~' ELSE coalesce(html, '') END
  FROM pages WHERE coalesce(page_id % 101, 0) <> 13
  UNION ALL SELECT 'b', -page_id - 1, url, coalesce(html, '') FROM pages WHERE page_id % 101 = 19),
d AS (SELECT side, page_id, coalesce(url, '') AS u, h, md5(coalesce(CAST(page_id AS VARCHAR), '')) AS d, coalesce('=' || CAST(page_id AS VARCHAR), '') AS k, chr(13) || chr(10) AS nl FROM p),
rec AS (
  SELECT side, page_id, k, 'WARC/1.0' || nl || 'WARC-Type: response' || nl || 'WARC-Record-ID: <urn:uuid:' || substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-' || substr(d, 13, 4) || '-' || substr(d, 17, 4) || '-' || substr(d, 21, 12)
    || '>' || nl || 'WARC-Target-URI: ' || u || nl || 'WARC-Date: 2024-01-01T00:00:00Z' || nl || 'Content-Type: text/html' || nl || 'Content-Length: ' || CAST(strlen(h) AS VARCHAR) || nl || nl || h || nl || nl AS r
  FROM d),
e AS (SELECT side, page_id, k, md5(k) AS m, sha256(r) AS digest, CAST(strlen(r) AS BIGINT) AS length, count(*) AS copies FROM rec GROUP BY ALL),
n AS (SELECT CAST(greatest(0, ceil(ln(greatest(1, max(n) / 4096.0)) / ln(16))) AS INTEGER) AS digits FROM (SELECT side, count(*) AS n FROM e GROUP BY side)),
f AS (SELECT e.*, substr(m, 1, digits) AS file FROM e, n),
o AS (SELECT *, coalesce(CAST(sum(length * copies) OVER (PARTITION BY side, file ORDER BY m, k, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS "offset" FROM f),
x AS (SELECT file, "offset", length, copies, k, digest FROM o GROUP BY ALL HAVING count(*) = 1),
ranges AS (SELECT DISTINCT file, "offset" // 65536 AS leaf FROM x),
both_sides AS (SELECT k, digest, max(CASE side WHEN 'a' THEN copies END) AS x, max(CASE side WHEN 'b' THEN copies END) AS y FROM o GROUP BY k, digest),
verdict AS (SELECT k, CASE WHEN bool_and(x IS NOT DISTINCT FROM y) THEN 'intact' WHEN count(y) = 0 THEN 'missing' WHEN count(x) = 0 THEN 'extra' ELSE 'corrupt' END AS status FROM both_sides GROUP BY k)
SELECT page_id, o.file, o."offset", length, copies, digest AS record_sha256, ranges.leaf IS NOT NULL AS range_differs, status
FROM o JOIN verdict USING (k) LEFT JOIN ranges ON ranges.file = o.file AND ranges.leaf = o."offset" // 65536
WHERE side = 'a' OR status = 'extra'
"""

"""Secondary structures as tables: bitmaps, covering, partial and expression indexes, an LSM tree, and column encodings.

A bitmap is a sparse table of 64-bit words, so AND, OR and NOT are joins and aggregates of words and any
number of rows can be indexed. The other indexes are sorted Parquet files with the columns they cover, in
which statistics, page indexes and Bloom filters find rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinql.operators.windows import in_pieces

# --- bitmaps --------------------------------------------------------------------------------------


def _word(row: Column) -> Column:
    return F.shiftright(row.cast("long"), 6)


def _bit(row: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), row.cast("long").bitwiseAND(F.lit(63)).cast("int"))


def bitmap_index(df: DataFrame, row: str, column: str) -> DataFrame:
    """(value, word, bits): for each value the rows (numbers from 0) that have it."""
    return df.groupBy(F.col(column).alias("value"), _word(F.col(row)).alias("word")).agg(F.bit_or(_bit(F.col(row))).alias("bits"))


def all_rows(df: DataFrame, row: str) -> DataFrame:
    """(word, bits) of all rows, what NOT takes away from."""
    return df.groupBy(_word(F.col(row)).alias("word")).agg(F.bit_or(_bit(F.col(row))).alias("bits"))


def bitmap(index: DataFrame, *values) -> DataFrame:
    """(word, bits) of the rows with any of some values."""
    found = index.where(F.col("value").isin(list(values)))
    return found.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def bitmap_and(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.join(b.withColumnRenamed("bits", "other"), "word").select("word", F.col("bits").bitwiseAND(F.col("other")).alias("bits"))
    return both.where("bits <> 0")


def bitmap_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def bitmap_not(a: DataFrame, everything: DataFrame) -> DataFrame:
    left = everything.join(a.withColumnRenamed("bits", "other"), "word", "left")
    return left.select("word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("other", F.lit(0).cast("long")))).alias("bits")).where("bits <> 0")


def bitmap_count(a: DataFrame) -> DataFrame:
    return a.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("n"))


def bitmap_rows(a: DataFrame) -> DataFrame:
    """(row) of a bitmap."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("getbit", F.col("bits"), k) == 1)
    return a.select(F.explode(F.transform(bits, lambda k: (F.col("word") * 64 + k).cast("long"))).alias("row"))


def range_bitmaps(df: DataFrame, row: str, column: str, bounds: Sequence) -> DataFrame:
    """(value, word, bits): for each bound the rows whose value is at most the bound."""
    ends = F.array(*[F.lit(b) for b in bounds])
    up_to = df.where(F.col(column).isNotNull()).select(row, F.explode(F.filter(ends, lambda b: b >= F.col(column))).alias("value"))
    return bitmap_index(up_to, row, "value")


def range_rows(index: DataFrame, above, up_to) -> DataFrame:
    """(word, bits) of the rows with above < value <= up_to; both are bounds of the index, above may be None."""
    high = bitmap(index, up_to)
    return high if above is None else bitmap_not(bitmap(index, above), high)


# --- sorted copies --------------------------------------------------------------------------------


class CoveringIndex:
    """A sorted copy of some columns of a table, of all rows or of those that meet a condition; keys may be expressions.

    Questions that it covers are answered from it alone (an index-only scan).
    """

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str], include: Sequence[str] = (), where: str | None = None) -> None:
        self.spark, self.path, self.keys, self.include, self.where = spark, path, dict(keys), list(include), where

    def build(self, df: DataFrame) -> "CoveringIndex":
        rows = df if self.where is None else df.where(self.where)
        own = rows.select(*[F.expr(e).alias(k) for k, e in self.keys.items()], *[c for c in self.include if c not in self.keys])
        writer = own.repartitionByRange(*self.keys).sortWithinPartitions(*self.keys).write.mode("overwrite")
        for k in self.keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
        writer.parquet(self.path)
        return self

    @property
    def columns(self) -> list[str]:
        return [*self.keys, *(c for c in self.include if c not in self.keys)]

    def covers(self, columns: Sequence[str], where: str | None = None) -> bool:
        """Whether a question for these columns, of rows with this condition, can be answered from the index."""
        return set(columns) <= set(self.columns) and (self.where is None or self.where == where)

    def find(self, condition: Column | str, columns: Sequence[str] | None = None) -> DataFrame:
        return self.spark.read.parquet(self.path).where(condition).select(*(columns or self.columns))


class LsmIndex:
    """Key to row, written as sorted runs: newer runs win over older ones, deletes are marks, and merging runs drops what is hidden."""

    def __init__(self, spark: SparkSession, root: str, key: str, schema: str, runs: int = 8) -> None:
        self.spark, self.root, self.key, self.limit = spark, root.rstrip("/"), key, runs
        self.schema = spark.createDataFrame([], schema).schema
        self.runs: list[tuple[int, str]] = []
        self.clock = 0

    def _add(self, rows: DataFrame) -> None:
        self.clock += 1
        path = f"{self.root}/run-{uuid.uuid4().hex}"
        rows.withColumn("_at", F.lit(self.clock)).repartitionByRange(self.key).sortWithinPartitions(self.key).write.option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(path)
        self.runs.append((self.clock, path))
        if len(self.runs) > self.limit:
            self.compact()

    def put(self, rows: DataFrame) -> None:
        self._add(rows.select([f.name for f in self.schema]).dropDuplicates([self.key]).withColumn("_gone", F.lit(False)))

    def delete(self, keys: DataFrame) -> None:
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name != self.key]
        self._add(keys.select(self.key).distinct().select(self.key, *rest, F.lit(True).alias("_gone")).select(*[f.name for f in self.schema], "_gone"))

    def _all(self) -> DataFrame | None:
        return self.spark.read.parquet(*[p for _, p in self.runs]) if self.runs else None

    def scan(self, condition: Column | str | None = None) -> DataFrame:
        """The newest rows; a condition on the key reaches the files."""
        rows = self._all()
        if rows is None:
            return self.spark.createDataFrame([], self.schema)
        rows = rows if condition is None else rows.where(condition)
        own = F.struct(*[f.name for f in self.schema], "_gone")
        return rows.groupBy(self.key).agg(F.max_by(own, "_at").alias("_r")).select("_r.*").where("NOT _gone").drop("_gone")

    def get(self, *keys) -> DataFrame:
        return self.scan(F.col(self.key).isin(list(keys)))

    def compact(self) -> None:
        """All runs become one, without what is hidden or deleted."""
        path = f"{self.root}/run-{uuid.uuid4().hex}"
        self.scan().withColumns({"_gone": F.lit(False), "_at": F.lit(self.clock)}).repartitionByRange(self.key).sortWithinPartitions(self.key).write.parquet(path)
        self.runs = [(self.clock, path)]


# --- encodings ------------------------------------------------------------------------------------


def dictionary_encoded(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(df with code in place of the column, dictionary (code, value)): codes by frequency, then value, from 0; null stays null."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    codes = counts.select("value", (F.row_number().over(Window.orderBy(F.desc("n"), "value")) - 1).alias("code"))  # a row for each value
    return df.join(codes.withColumnRenamed("value", column), column, "left").drop(column), codes.select("code", "value")


def run_lengths(df: DataFrame, by: Sequence[str], order: str, column: str) -> DataFrame:
    """(by, run, value, length): runs of equal values in order."""
    w = Window.partitionBy(*by).orderBy(order)
    new = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.col(column).eqNullSafe(F.lag(column).over(w))).cast("int"))
    runs = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "run").agg(F.first(column).alias("value"), F.count("*").alias("length"))


def deltas(df: DataFrame, by: Sequence[str], order: str, column: str) -> DataFrame:
    """df with delta: the difference to the value before (the first one's own value)."""
    before = F.lag(column).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("delta", F.col(column) - F.coalesce(before, F.lit(0)))


def from_deltas(df: DataFrame, by: Sequence[str], order: str) -> Column:
    """The values again."""
    return F.sum("delta").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def framed(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """(by, base, width): a frame of reference: the least value and the bits that offsets from it take."""
    one = df.groupBy(*by).agg(F.min(column).alias("base"), F.max(column).alias("top"))
    return one.select(*by, "base", F.when(F.col("top") == F.col("base"), 0).otherwise(F.length(F.bin((F.col("top") - F.col("base")).cast("long")))).cast("int").alias("width"))


def best_encoding(df: DataFrame, column: str, order: str) -> DataFrame:
    """(encoding, bytes): the estimated size of an integer column under each encoding, smallest first; one pass and one sort, in pieces of the order."""
    x, _ = in_pieces(df.select(F.col(order).alias("o"), F.col(column).cast("long").alias("v")), ["o"])
    last = x.groupBy("_piece").agg(F.max_by(F.struct("v"), "o").alias("l"))  # a row for each piece
    last = last.select("_piece", F.lag("l").over(Window.orderBy("_piece"))["v"].alias("b"))
    w = Window.partitionBy("_piece").orderBy("o")
    x = x.join(F.broadcast(last), "_piece").select("v", F.when(F.row_number().over(w) == 1, F.col("b")).otherwise(F.lag("v").over(w)).alias("p"))
    wide = lambda c: F.length(F.bin(F.greatest(c, F.lit(1))))
    s = x.agg(F.count("*").alias("n"), F.count_distinct("v").alias("d"), F.count_if(~F.col("v").eqNullSafe(F.col("p"))).alias("runs"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.max(F.abs(F.col("v") - F.col("p"))).alias("step"))
    sizes = {"plain": F.col("n") * 8, "dictionary": F.col("d") * 8 + F.ceil(F.col("n") * wide(F.col("d") - 1) / 8), "run-length": F.col("runs") * 12, "frame of reference": 8 + F.ceil(F.col("n") * wide(F.col("hi") - F.col("lo")) / 8), "delta": 8 + F.ceil(F.col("n") * (wide(F.coalesce("step", F.lit(0).cast("long"))) + 1) / 8)}
    rows = F.array(*[F.struct(F.lit(k).alias("encoding"), v.cast("long").alias("bytes")) for k, v in sizes.items()])
    return s.select(F.inline(rows)).orderBy("bytes", "encoding")

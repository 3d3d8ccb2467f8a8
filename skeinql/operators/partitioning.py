"""Partition layouts as derived columns and writers: range, hash, list, composite and by time; layout advice."""

from __future__ import annotations

import datetime
import uuid
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinql.operators.joins import small_side


def range_partition(c: str, bounds: Sequence) -> Column:
    """0 below the first bound, 1 from it, and so on."""
    return sum(((F.col(c) >= F.lit(b)).cast("int") for b in bounds), F.lit(0))


def hash_partition(c: str, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def list_partition(c: str, lists: dict[str, Sequence], default: str = "other") -> Column:
    out = F.lit(default)
    for name, values in lists.items():
        out = F.when(F.col(c).isin(list(values)), name).otherwise(out)
    return out


def time_partition(c: str, unit: str) -> Column:
    """day, week, month or year."""
    return F.date_trunc(unit, F.col(c)).cast("date")


def write_partitioned(df: DataFrame, path: str, mode: str = "overwrite", rows_per_task: int = 1_000_000, **columns: Column) -> None:
    """One folder for each value of the derived columns.

    Rows of a value go to about as many tasks as it has times ``rows_per_task`` rows, so a value with a third
    of all rows is written by many and a rare one makes one file.
    """
    placed = df.withColumns(columns)
    tasks = placed.groupBy(*columns).agg(F.ceil(F.count("*") / F.lit(rows_per_task)).cast("int").alias("_tasks"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns]
    salted = placed.alias("l").join(small_side(tasks).alias("r"), same, "left").select("l.*", F.pmod(F.xxhash64(*[F.col(f"l.{c}") for c in df.columns]), F.col("_tasks")).alias("_salt"))
    salted.repartition(*columns, "_salt").drop("_salt").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def merged_partitions(df: DataFrame, column: str, names: Sequence, into) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column).isin(list(names)), F.lit(into)).otherwise(F.col(column)))


def sorted_layout(df: DataFrame, columns: Sequence[str], path: str, bloom: Sequence[str] = ()) -> None:
    """Range-sorted files, so that row-group and page statistics skip; Bloom filters for point look-ups."""
    writer = df.repartitionByRange(*columns).sortWithinPartitions(*columns).write.mode("overwrite")
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


def advise(conditions: Sequence[tuple[str, str]], least: int = 2) -> list[tuple[str, str, int]]:
    """(column, layout, uses) for filtered columns of a query log of (column, operator), most used first."""
    uses = Counter(c for c, _ in conditions)
    out = []
    for c, n in uses.most_common():
        if n >= least:
            ops = {o for x, o in conditions if x == c}
            out.append((c, "range-sorted" if ops & {"<", ">", "<=", ">=", "between"} else "bloom filter", n))
    return out


class RangePartitions:
    """A table in folders of ranges [low, high) of one column, whose ranges can be added, dropped, split and merged.

    A change rewrites only the folders it touches; the list of ranges moves last, so readers see the old one until then.
    """

    def __init__(self, spark: SparkSession, root: str, column: str) -> None:
        self.spark, self.root, self.column = spark, root.rstrip("/"), column
        self.ranges: list[tuple[object, object, str | None]] = []  # (low, high, folder or None while empty)

    def _inside(self, low, high) -> Column:
        return (F.col(self.column) >= F.lit(low)) & (F.col(self.column) < F.lit(high))

    def _write(self, rows: DataFrame) -> str:
        folder = f"{self.root}/p-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return folder

    def add(self, low, high) -> None:
        if any(low < h and l < high for l, h, _ in self.ranges):
            raise ValueError(f"[{low}, {high}) meets another partition")
        self.ranges = sorted([*self.ranges, (low, high, None)], key=lambda r: r[0])

    def add_periods(self, start: datetime.date, periods: int, unit: str) -> None:
        """Partitions of a day, week, month or year each, one after another from the one that a date is in."""
        at = {"day": start, "week": start - datetime.timedelta(days=start.weekday()), "month": start.replace(day=1), "year": start.replace(month=1, day=1)}[unit]
        for _ in range(periods):
            months = at.year * 12 + at.month - 1 + {"month": 1, "year": 12}.get(unit, 0)
            after = at + datetime.timedelta(days={"day": 1, "week": 7}[unit]) if unit in ("day", "week") else datetime.date(months // 12, months % 12 + 1, 1)
            self.add(at, after)
            at = after

    def insert(self, rows: DataFrame) -> None:
        """Rows that no partition takes forbid the insert."""
        out = F.lit(False)
        for low, high, _ in self.ranges:
            out = out | self._inside(low, high)
        if not rows.where(~F.coalesce(out, F.lit(False))).isEmpty():
            raise ValueError("rows outside of all partitions")
        new = []
        for low, high, folder in self.ranges:
            part = rows.where(self._inside(low, high))
            old = None if folder is None else self.spark.read.parquet(folder)
            new.append((low, high, folder if part.isEmpty() else self._write(part if old is None else old.unionByName(part))))
        self.ranges = new

    def drop(self, low) -> None:
        self.ranges = [r for r in self.ranges if r[0] != low]

    def split(self, low, at) -> None:
        (l, h, folder), rest = next(r for r in self.ranges if r[0] == low), [r for r in self.ranges if r[0] != low]
        if not l < at < h:
            raise ValueError(f"{at} is not inside of the partition")
        halves = [(l, at, None), (at, h, None)] if folder is None else [(a, b, self._write(self.spark.read.parquet(folder).where(self._inside(a, b)))) for a, b in ((l, at), (at, h))]
        self.ranges = sorted([*rest, *halves], key=lambda r: r[0])

    def merge(self, low, high) -> None:
        """The partition that begins at low and its neighbours up to high become one."""
        own = [r for r in self.ranges if low <= r[0] and r[1] <= high]
        if not own or own[0][0] != low or own[-1][1] != high or any(a[1] != b[0] for a, b in zip(own, own[1:])):
            raise ValueError("partitions do not follow each other")
        folders = [f for _, _, f in own if f]
        folder = self._write(self.spark.read.parquet(*folders)) if folders else None
        self.ranges = sorted([*[r for r in self.ranges if r not in own], (low, high, folder)], key=lambda r: r[0])

    def read(self, low=None, high=None) -> DataFrame:
        """Rows of a range; only folders of partitions that meet it are read."""
        folders = [f for l, h, f in self.ranges if f and (high is None or l < high) and (low is None or h > low)]
        if not folders:
            raise ValueError("no rows in these partitions")
        rows = self.spark.read.parquet(*folders)
        rows = rows if low is None else rows.where(F.col(self.column) >= F.lit(low))
        return rows if high is None else rows.where(F.col(self.column) < F.lit(high))


class ShardMap:
    """Which of some shards (folders) a row belongs to, by hash, range or list, and queries over one, some or all shards."""

    def __init__(self, spark: SparkSession, shards: Sequence[str], column: str, kind: str = "hash", bounds: Sequence = (), lists: dict[str, Sequence] | None = None) -> None:
        self.spark, self.shards, self.column = spark, list(shards), column
        self.kind, self.bounds, self.lists = kind, list(bounds), lists or {}

    def shard(self) -> Column:
        """The number of a row's shard."""
        if self.kind == "hash":
            return hash_partition(self.column, len(self.shards))
        if self.kind == "range":
            return range_partition(self.column, self.bounds)
        out = F.lit(len(self.lists))
        for n, values in enumerate(self.lists.values()):
            out = F.when(F.col(self.column).isin(list(values)), n).otherwise(out)
        return out

    def write(self, rows: DataFrame) -> None:
        placed = rows.withColumn("_shard", self.shard())
        for n, path in enumerate(self.shards):
            placed.where(F.col("_shard") == n).drop("_shard").write.mode("append").parquet(path)

    def read(self, *values) -> DataFrame:
        """All rows, or those of some values of the column, from their shards only."""
        if not values:
            return self.spark.read.parquet(*self.shards)
        kind = self.spark.read.parquet(self.shards[0]).schema[self.column].dataType
        own = self.spark.createDataFrame([(v,) for v in values], f"`{self.column}` {kind.simpleString()}").select(self.shard().alias("s")).distinct().collect()
        return self.spark.read.parquet(*[self.shards[r.s] for r in own]).where(F.col(self.column).isin(list(values)))

"""Window helpers: a builder, GROUPS frames, and frames that leave out the current row, its group or its ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from skeinql.session import scratch


class WindowBuilder:
    """Partition, order and frame, put together step by step."""

    def __init__(self) -> None:
        self._by: tuple = ()
        self._order: tuple = ()
        self._frame: tuple | None = None

    def partition_by(self, *columns) -> "WindowBuilder":
        self._by = columns
        return self

    def order_by(self, *columns) -> "WindowBuilder":
        self._order = columns
        return self

    def rows(self, start: int, end: int) -> "WindowBuilder":
        self._frame = ("rows", start, end)
        return self

    def range(self, start: int, end: int) -> "WindowBuilder":
        self._frame = ("range", start, end)
        return self

    def whole_partition(self) -> "WindowBuilder":
        return self.rows(Window.unboundedPreceding, Window.unboundedFollowing)

    def sliding(self, before: int) -> "WindowBuilder":
        return self.rows(-before, 0)

    def centered(self, each_side: int) -> "WindowBuilder":
        return self.rows(-each_side, each_side)

    def cumulative(self) -> "WindowBuilder":
        return self.rows(Window.unboundedPreceding, 0)

    def build(self) -> WindowSpec:
        spec = Window.partitionBy(*self._by)
        if self._order:
            spec = spec.orderBy(*self._order)
        if self._frame:
            kind, start, end = self._frame
            spec = spec.rowsBetween(start, end) if kind == "rows" else spec.rangeBetween(start, end)
        return spec


def over_groups(df: DataFrame, by: Sequence[str], order: Sequence[str], before: int, after: int, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over GROUPS BETWEEN before AND after: peers are numbered, and the frame is a range of the numbers."""
    numbered = df.withColumn("_peer", F.dense_rank().over(Window.partitionBy(*by).orderBy(*order)))
    frame = Window.partitionBy(*by).orderBy("_peer").rangeBetween(before, after)
    return numbered.withColumns({n: a.over(frame) for n, a in aggregates.items()}).drop("_peer")


def sum_excluding(value: str, by: Sequence[str], order: Sequence[str], exclude: str) -> Column:
    """Sum over the whole partition but the current row, its group of peers, or its ties (peers but itself); null if nothing is left."""
    whole, peers = Window.partitionBy(*by), Window.partitionBy(*by, *order)
    own, one = F.coalesce(F.col(value), F.lit(0.0)), F.lit(1)
    total, n = F.coalesce(F.sum(value).over(whole), F.lit(0.0)), F.count(one).over(whole)
    group, m = F.coalesce(F.sum(value).over(peers), F.lit(0.0)), F.count(one).over(peers)
    left, rows = {"current row": (total - own, n - 1), "group": (total - group, n - m), "ties": (total - group + own, n - m + 1)}[exclude]
    return F.when(rows > 0, left)


#: Rows of a piece of an order.
PIECE_ROWS = 500_000


def in_pieces(df: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """(df with _piece, pieces): consecutive rows of an order are one piece, so that an order over all rows needs no task for all.

    Rows are written once, as ranges found by sampling differ from one reading to the next. One piece is left as it is.
    """
    n = df.count() // PIECE_ROWS + 1
    if n == 1:
        return df.withColumn("_piece", F.lit(0)), 1
    path = scratch(df.sparkSession, "pieces")
    df.repartitionByRange(n, *order).withColumn("_piece", F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path), n

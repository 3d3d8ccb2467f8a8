"""Joins that Spark has no single word for: as-of, interval, range by buckets, lookup, salted, size-checked broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows up to which a counted side is broadcast.
BROADCAST_ROWS = 1_000_000


def small_join(left: DataFrame, right: DataFrame, on, how: str = "inner", bound: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast the right side if it is counted to have at most so many rows; else leave the choice to AQE."""
    few = right.limit(bound + 1).count() <= bound
    return left.join(F.broadcast(right) if few else right, on, how)


def small_side(right: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """A side to broadcast if it is counted to have at most so many rows."""
    return F.broadcast(right) if right.limit(bound + 1).count() <= bound else right


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str], tolerance: str | None = None, pieces: int = 8) -> DataFrame:
    """Each left row with the values of the last right row at or before it with the same keys (nulls if there is none).

    One union and one sort carry the last right row's values forward, within pieces of the time axis: at most
    ``pieces`` of them by approximate percentiles of the right side's times, so that one key is spread. The last
    right row of each key and piece, carried over the pieces, is what a piece begins with.
    """
    cuts = right.select(F.unix_micros(F.col(right_time).cast("timestamp")).alias("t") if _is_time(right, right_time) else F.col(right_time).cast("double").alias("t"))
    bounds = sorted(set(cuts.agg(F.percentile_approx("t", [k / pieces for k in range(1, pieces)], 1000)).first()[0] or [])) if pieces > 1 else []
    number = lambda df, c: F.unix_micros(F.col(c).cast("timestamp")) if _is_time(df, c) else F.col(c).cast("double")
    piece = lambda df, c: F.coalesce(sum(((number(df, c) >= b).cast("int") for b in bounds), F.lit(0)), F.lit(0))
    kept = F.struct(*[F.col(c) for c in left.columns])
    rows = left.select(*by, F.col(left_time).alias("_t"), piece(left, left_time).alias("_p"), F.lit(1).alias("_kind"), kept.alias("_row"), F.lit(None).alias("_v"))
    value = F.struct(F.col(right_time).alias("_at"), *values)
    marks = right.select(*by, F.col(right_time).alias("_t"), piece(right, right_time).alias("_p"), F.lit(0).alias("_kind"), F.lit(None).alias("_row"), value.alias("_v"))
    both = rows.unionByName(marks)
    if bounds:
        # the last right row of a key in a piece is where its next pieces begin
        last = marks.groupBy(*by, "_p").agg(F.max_by("_v", "_t").alias("_v"))
        grid = last.select(*by).distinct().withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(len(bounds)))))
        before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        begun = grid.alias("g").join(last.alias("m"), [F.col(f"g.{c}").eqNullSafe(F.col(f"m.{c}")) for c in by] + [F.col("g._p") == F.col("m._p")], "left").select("g.*", "m._v").withColumn("_v", F.last("_v", ignorenulls=True).over(before)).where("_v IS NOT NULL")
        both = both.unionByName(begun.select(*by, F.lit(None).cast(left.schema[left_time].dataType).alias("_t"), "_p", F.lit(-1).alias("_kind"), F.lit(None).alias("_row"), "_v"))
    order = Window.partitionBy(*by, "_p").orderBy(F.col("_t").asc_nulls_first(), "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_last", F.last("_v", ignorenulls=True).over(order)).where("_kind = 1")
    ok = F.col("_t").isNotNull() if tolerance is None else F.col("_last._at") >= F.col("_t") - F.expr(f"INTERVAL {tolerance}")
    return out.select("_row.*", *[F.when(ok, F.col(f"_last.{v}")).alias(v) for v in values])


def _is_time(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.typeName() in ("timestamp", "timestamp_ntz", "date")


def interval_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs with the same keys and times at most so many seconds apart.

    Times fall in buckets as long as the interval; the right side is put in the three that can match, so the
    join has equal keys and rows far apart never meet.
    """
    bucket = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / F.lit(seconds)).cast("long")
    near = right.withColumn("_b", F.explode(F.array(*[bucket(right_time) + d for d in (-1, 0, 1)])))
    marked = left.withColumn("_b", bucket(left_time))
    cond = [marked[c] == near[c] for c in by] + [marked["_b"] == near["_b"], F.abs(F.unix_micros(marked[left_time].cast("timestamp")) - F.unix_micros(near[right_time].cast("timestamp"))) <= seconds * 1_000_000]
    return marked.join(near, cond).drop("_b")


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= value < high. A range is put in each bucket of so much width that it touches, so the join is by equal buckets."""
    spread = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long"))))
    placed = points.withColumn("_b", F.floor(F.col(value) / width).cast("long"))
    return placed.join(spread, "_b").where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_b")


def lookup(left: DataFrame, right: DataFrame, local: str, foreign: str, into: str) -> DataFrame:
    """Left rows with an array of all matching right rows (empty if none)."""
    lists = right.groupBy(F.col(foreign).alias("_k")).agg(F.sort_array(F.collect_list(F.struct(*right.columns))).alias(into))
    out = left.join(lists, left[local] == F.col("_k"), "left").drop("_k")
    return out.withColumn(into, F.coalesce(into, F.array().cast(lists.schema[into].dataType)))


def salted_join(left: DataFrame, right: DataFrame, on: str, salts: int = 16, how: str = "inner", hot: float = 0.01) -> DataFrame:
    """Equi-join of a left side with hot keys, those with more than a share of its rows.

    Only rows of hot keys are spread over salts, and only the right rows of these keys (at most 1 / hot of them)
    are repeated for each; all others are joined as they are.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("only joins that keep left rows can be salted")
    counts = left.groupBy(on).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    keys = [r[0] for r in counts.where((F.col("_n") > F.lit(hot * total)) & F.col(on).isNotNull()).select(on).collect()]  # at most 1 / hot
    if not keys or len(keys) * 2 >= total:
        return left.join(right, on, how)
    is_hot = F.coalesce(F.col(on).isin(keys), F.lit(False))
    l = left.where(is_hot).withColumn("_s", F.pmod(F.xxhash64(*left.columns, F.monotonically_increasing_id()), F.lit(salts)))
    r = right.where(is_hot).withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    spread = l.join(r, [on, "_s"], how).drop("_s")
    return left.where(~is_hot).join(right.where(~is_hot), on, how).unionByName(spread)


def bloom_filter(keys: DataFrame, on: str, bits: int = 1 << 16, hashes: int = 4) -> DataFrame:
    """(bloom): one row with the set bits of all keys as 64-bit words, so bits bounds what is broadcast (8 KB by default)."""
    spots = F.array(*[F.pmod(F.xxhash64(F.col(on), F.lit(k)), F.lit(bits)) for k in range(hashes)])
    one = keys.where(F.col(on).isNotNull()).select(F.explode(spots).alias("s"))
    words = one.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(F.lit(63)).cast("int"))).alias("b"))
    held = F.map_from_entries(F.collect_list(F.struct("w", "b")))
    return words.agg(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(bits // 64 - 1).cast("long")), lambda w: F.coalesce(F.try_element_at(held, w), F.lit(0).cast("long"))).alias("bloom"))


def bloom_join(left: DataFrame, right: DataFrame, on: str, bits: int = 1 << 16, hashes: int = 4) -> DataFrame:
    """Inner join of which left rows whose key is surely not on the right are dropped before anything is shuffled."""
    k = F.col(on)
    spots = [F.pmod(F.xxhash64(k, F.lit(n)), F.lit(bits)) for n in range(hashes)]
    maybe = F.lit(True)
    for s in spots:
        maybe = maybe & (F.call_function("getbit", F.get("bloom", F.shiftright(s, 6).cast("int")), s.bitwiseAND(F.lit(63)).cast("int")) == 1)
    few = left.crossJoin(F.broadcast(bloom_filter(right, on, bits, hashes))).where(maybe).select(*left.columns)
    return few.join(right, on)


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def versioned_join(left: DataFrame, right: DataFrame, on: str, time: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Each left row with the right version that was valid at its time."""
    valid = (left[time] >= right[start]) & ((left[time] < right[end]) | right[end].isNull())
    return left.join(right, (left[on] == right[on]) & valid, "left").drop(right[on])


def any_of(value: Column, op: str, low: Column, high: Column) -> Column:
    """value op ANY (set), by the set's smallest and largest member."""
    return {">": value > low, ">=": value >= low, "<": value < high, "<=": value <= high}[op]


def all_of(value: Column, op: str, low: Column, high: Column) -> Column:
    """value op ALL (set): true for an empty set."""
    return F.coalesce({">": value > high, ">=": value >= high, "<": value < low, "<=": value <= low}[op], F.lit(True))

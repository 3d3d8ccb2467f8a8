"""Row versions: as-of reads, versions between, bi-temporal reads, diffs, slowly changing dimensions, change capture.

A version table has a key, valid_from and valid_to (null: still valid) beside its columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def versions_of(events: DataFrame, key: Sequence[str], at: str) -> DataFrame:
    """A version table from a log of row states: each state is valid until the key's next one."""
    later = F.lead(at).over(Window.partitionBy(*key).orderBy(at))
    return events.withColumns({"valid_from": F.col(at), "valid_to": later}).drop(at)


def as_of(versions: DataFrame, at: Column) -> DataFrame:
    return versions.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))))


def versions_between(versions: DataFrame, start: Column, end: Column) -> DataFrame:
    return versions.where((F.col("valid_from") < end) & (F.col("valid_to").isNull() | (F.col("valid_to") > start)))


def bitemporal(versions: DataFrame, transaction: Column, valid: Column, tx_from: str = "tx_from", tx_to: str = "tx_to") -> DataFrame:
    """What was known at the transaction time about the valid time."""
    known = (F.col(tx_from) <= transaction) & (F.col(tx_to).isNull() | (transaction < F.col(tx_to)))
    return as_of(versions.where(known), valid)


def version_changes(versions: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(key, valid_from, column, before, after) for each column that a version changed."""
    w = Window.partitionBy(*key).orderBy("valid_from")
    first = F.row_number().over(w) == 1
    each = [F.when(~first & ~F.lag(c).over(w).eqNullSafe(F.col(c)), F.struct(F.lit(c).alias("column"), F.lag(c).over(w).cast("string").alias("before"), F.col(c).cast("string").alias("after"))) for c in columns]
    changed = versions.select(*key, "valid_from", F.array(*each).alias("_c"))
    return changed.select(*key, "valid_from", F.explode(F.filter("_c", lambda x: x.isNotNull())).alias("_x")).select(*key, "valid_from", "_x.*")


def change_capture(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """(op, key, before, after): insert, update or delete of each key that differs between two snapshots."""
    a = before.select(*key, F.struct(*before.columns).alias("before"))
    b = after.select(*key, F.struct(*after.columns).alias("after"))
    op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").when(~F.col("before").eqNullSafe(F.col("after")), "update")
    return a.join(b, list(key), "full").withColumn("op", op).where("op IS NOT NULL").select("op", *key, "before", "after")


def apply_changes(base: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """A snapshot after captured changes."""
    kept = base.join(changes.select(*key), list(key), "left_anti")
    return kept.unionByName(changes.where("op <> 'delete'").select("after.*").select(*base.columns))


def scd1(dimension: DataFrame, news: DataFrame, key: Sequence[str]) -> DataFrame:
    """New attributes overwrite the old ones."""
    return dimension.join(news.select(*key), list(key), "left_anti").unionByName(news.select(*dimension.columns))


def scd2(versions: DataFrame, news: DataFrame, key: Sequence[str], at: Column) -> DataFrame:
    """Close the open versions whose attributes changed, and open new ones."""
    attributes = [c for c in news.columns if c not in key]
    fresh = news.select(*key, F.struct(*attributes).alias("_new"))
    x = versions.join(fresh, list(key), "left")
    open_ = F.col("valid_to").isNull()
    changed = open_ & F.col("_new").isNotNull() & ~F.struct(*[F.col(a) for a in attributes]).eqNullSafe(F.col("_new"))
    closed = x.withColumn("valid_to", F.when(changed, at).otherwise(F.col("valid_to"))).select(*versions.columns)
    same = x.where(open_ & F.col("_new").isNotNull() & ~changed).select(*key)
    opened = news.join(same, list(key), "left_anti").withColumns({"valid_from": at, "valid_to": F.lit(None).cast(versions.schema["valid_to"].dataType)})
    return closed.unionByName(opened.select(*versions.columns))


def scd3(dimension: DataFrame, news: DataFrame, key: Sequence[str], attribute: str) -> DataFrame:
    """Keep the value before the last change in previous_<attribute>."""
    fresh = news.select(*key, F.col(attribute).alias("_new"))
    x = dimension.join(fresh, list(key), "left")
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col(attribute))
    previous = f"previous_{attribute}"
    before = F.col(previous) if previous in dimension.columns else F.lit(None).cast(dimension.schema[attribute].dataType)
    return x.withColumns({previous: F.when(changed, F.col(attribute)).otherwise(before), attribute: F.when(changed, F.col("_new")).otherwise(F.col(attribute))}).drop("_new")

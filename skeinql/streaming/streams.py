"""Structured Streaming: event-time windows, watermarks, deduplication, joins, top-n, anomalies and stateful patterns.

Each function takes and gives a (streaming) DataFrame. ``drain`` runs a query over all that is available
and gives the result as a table, which is how tests and the registered queries hold streams against batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinql.session import scratch


def file_stream(spark: SparkSession, folder: str, schema, kind: str = "parquet", files_per_trigger: int | None = None, **options: str) -> DataFrame:
    """A stream of the files of a folder (or of a file named in a glob)."""
    reader = spark.readStream.format(kind).schema(schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def windowed(df: DataFrame, ts: str, size: str, aggregates: dict[str, Column], keys: Sequence[str] = (), slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling (or, with slide, sliding) windows; rows later than the watermark are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = df.withWatermark(ts, late).groupBy(*keys, w.alias("w")).agg(*[a.alias(n) for n, a in aggregates.items()])
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *aggregates)


def sessions(df: DataFrame, ts: str, gap: str, aggregates: dict[str, Column], keys: Sequence[str], late: str = "10 minutes") -> DataFrame:
    out = df.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(*[a.alias(n) for n, a in aggregates.items()])
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *aggregates)


def deduplicated(df: DataFrame, ts: str, keys: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, within: str, late: str = "10 minutes", how: str = "inner") -> DataFrame:
    """Stream-stream join of rows at most so far apart; columns get the prefixes left_ and right_."""
    a = left.withWatermark(left_ts, late).select(*[F.col(c).alias(f"left_{c}") for c in left.columns])
    b = right.withWatermark(right_ts, late).select(*[F.col(c).alias(f"right_{c}") for c in right.columns])
    cond = " AND ".join([f"left_{k} = right_{k}" for k in keys] + [f"right_{right_ts} BETWEEN left_{left_ts} - INTERVAL {within} AND left_{left_ts} + INTERVAL {within}"])
    return a.join(b, F.expr(cond), how)


def latest(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """The newest row of each key, for complete or update output."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ts).alias("r")).select(*keys, "r.*")


def anomalies(df: DataFrame, ts: str, value: str, keys: Sequence[str], size: str, k: float = 3.0, late: str = "10 minutes") -> DataFrame:
    """Windows whose largest value is over k standard deviations from their mean."""
    out = windowed(df, ts, size, {"mean": F.avg(value), "sd": F.stddev_pop(value), "top": F.max(value), "n": F.count(value)}, keys, late=late)
    return out.where((F.col("sd") > 0) & ((F.col("top") - F.col("mean")) / F.col("sd") > k))


def alerts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that a row breaks, in a column alert."""
    hits = F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])
    return df.withColumn("alert", F.explode(F.filter(hits, lambda x: x.isNotNull())))


def sequence_counts(df: DataFrame, key: str, ts: str, first: Column, second: Column) -> DataFrame:
    """(key, matches): second events that follow a first one, kept as state for each key over micro-batches.

    Rows of a micro-batch are put in time order for each key; the state is whether a first event is open
    and how many matches there were.
    """
    rows = df.select(F.col(key).alias("k"), F.col(ts).cast("timestamp").alias("t"), F.when(first, 1).when(second, 2).otherwise(0).alias("m"))

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        is_open, n = state.get if state.exists else (False, 0)
        for m in pd.concat(list(batches)).sort_values("t")["m"]:
            if m == 1:
                is_open = True
            elif m == 2 and is_open:
                is_open, n = False, n + 1
        state.update((bool(is_open), int(n)))
        yield pd.DataFrame({"k": [k[0]], "matches": [int(n)]})

    kind = df.schema[key].dataType.simpleString()
    return rows.groupBy("k").applyInPandasWithState(run, f"k {kind}, matches long", "open boolean, n long", "update", "NoTimeout")


def drain(df: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run until everything that is available is processed; a table of the files that it wrote.

    Each micro-batch overwrites a folder of its own, so a repeated batch counts once. In append and update mode
    the table has all batches' rows, in complete mode those of the last one.
    """
    spark, root = df.sparkSession, scratch(df.sparkSession, "drain")
    empty = spark.createDataFrame([], df.schema)

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}")

    query = df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint or f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/out")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    batches = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p)) if fs.exists(p) else []
    if not batches:
        return empty
    out = spark.read.schema(df.schema)
    return out.parquet(f"{root}/out/batch={batches[-1]}") if mode == "complete" else out.parquet(*[f"{root}/out/batch={n}" for n in batches])


def to_files(df: DataFrame, path: str, checkpoint: str, kind: str = "parquet", by: Sequence[str] = ()) -> None:
    """Append all that is available to files, exactly once."""
    df.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).partitionBy(*by).trigger(availableNow=True).start().awaitTermination()


def for_each_batch(df: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Hand each micro-batch to a function: other sinks, upserts, two sinks at once. The function must bear a repeated batch id."""
    df.writeStream.foreachBatch(f).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def publish(df: DataFrame, root: str, topic: str, key: str, partitions: int = 4) -> None:
    """Append rows to a topic: a folder with a sub-folder for each partition of the key."""
    df.withColumn("partition", F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")).write.mode("append").partitionBy("partition").parquet(f"{root}/{topic}")


def subscribe(spark: SparkSession, root: str, topic: str, schema, condition: Column | None = None) -> DataFrame:
    """A stream of a topic; its checkpoint keeps a subscriber's position."""
    out = spark.readStream.schema(schema).parquet(f"{root}/{topic}")
    return out if condition is None else out.where(condition)


def compacted(df: DataFrame, keys: Sequence[str], ts: str, deleted: str | None = None) -> DataFrame:
    """The newest row of each key of a log, without those marked as deleted."""
    out = latest(df, keys, ts)
    return out.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else out


def compatible(old, new, mode: str = "backward") -> list[str]:
    """What keeps a new schema from reading (backward) or being read by (forward) an old one; 'full' is both."""
    def gaps(writer, reader) -> list[str]:
        have = {f.name: f for f in writer.fields}
        out = []
        for f in reader.fields:
            if f.name not in have:
                if not f.nullable:
                    out.append(f"{f.name} is required and missing")
            elif have[f.name].dataType != f.dataType:
                out.append(f"{f.name} changed from {have[f.name].dataType.simpleString()} to {f.dataType.simpleString()}")
        return out

    return (gaps(old, new) if mode in ("backward", "full") else []) + (gaps(new, old) if mode in ("forward", "full") else [])


class SchemaRegistry:
    """Versions of schemas by subject; a new one must be compatible with the last (backward, forward, full) or with all (transitive)."""

    def __init__(self, mode: str = "backward", transitive: bool = False) -> None:
        self.mode, self.transitive = mode, transitive
        self._versions: dict[str, list] = {}

    def register(self, subject: str, schema) -> int:
        """The number of the version; that of an equal one if there is one."""
        known = self._versions.setdefault(subject, [])
        if schema in known:
            return known.index(schema) + 1
        gaps = [g for old in (known if self.transitive else known[-1:]) for g in compatible(old, schema, self.mode)] if self.mode != "none" else []
        if gaps:
            raise ValueError(f"{subject}: " + "; ".join(gaps))
        known.append(schema)
        return len(known)

    def get(self, subject: str, version: int | None = None):
        return self._versions[subject][(version or 0) - 1]

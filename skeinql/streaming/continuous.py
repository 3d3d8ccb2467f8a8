"""Continuous queries: their life, how they refresh and where results go; late rows, and windows with triggers and eviction."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinql.operators.windows import in_pieces
from skeinql.session import scratch


class ContinuousQueries:
    """Queries by name over streams: created, started, paused, resumed, refreshed and dropped.

    refresh: 'continuous' (as data comes), 'periodic' (every so many seconds) or 'demand' (when refresh() is
    called). sink: 'table' (upserts by key into a table of files), 'file' (appended files) or a function of
    (rows, batch number). A query's checkpoint keeps its place and state, so a pause, a stop or a lost driver
    loses nothing and repeats nothing.
    """

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.root = spark, (root or scratch(spark, "continuous")).rstrip("/")
        self._queries: dict[str, dict] = {}

    def create(self, name: str, build: Callable[[], DataFrame], sink: str | Callable[[DataFrame, int], None] = "table", key: Sequence[str] = (), refresh: str = "demand", seconds: float = 10.0) -> None:
        if name in self._queries:
            raise ValueError(f"query {name} is there already")
        if refresh not in ("continuous", "periodic", "demand"):
            raise ValueError(f"no refresh {refresh}")
        if sink == "table" and not key:
            raise ValueError("a table needs a key")
        self._queries[name] = {"build": build, "sink": sink, "key": list(key), "refresh": refresh, "seconds": seconds, "state": "created", "run": None, "batches": 0, "rows": 0}

    def _put(self, name: str) -> Callable[[DataFrame, int], None]:
        q, root = self._queries[name], f"{self.root}/{name}"

        def run(batch: DataFrame, n: int) -> None:
            if callable(q["sink"]):
                q["sink"](batch, n)
            elif q["sink"] == "file":
                batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}")
            else:
                old = self._versions(name)
                old = [v for v in old if v < n]  # a repeated batch starts from the version before it
                if old:
                    before = self.spark.read.schema(batch.schema).parquet(f"{root}/table/v={old[-1]}")
                    batch.persist()
                    rows = before.join(batch.select(*q["key"]), q["key"], "left_anti").select(batch.columns).unionByName(batch)
                else:
                    rows = batch
                rows.write.mode("overwrite").parquet(f"{root}/table/v={n}")
                batch.unpersist()
            q["batches"] += 1

        return run

    def _versions(self, name: str) -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/table")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        done = [n for n in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/table/{n}/_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in done if n.startswith("v="))

    def _begin(self, name: str, now: bool) -> None:
        q = self._queries[name]
        df = q["build"]()
        writer = df.writeStream.foreachBatch(self._put(name)).outputMode("update" if q["sink"] == "table" else "append").option("checkpointLocation", f"{self.root}/{name}/checkpoint").queryName(name)
        writer = writer.trigger(availableNow=True) if now else writer.trigger(processingTime=f"{q['seconds']} seconds" if q["refresh"] == "periodic" else "0 seconds")
        q["run"] = writer.start()

    def start(self, name: str) -> None:
        q = self._queries[name]
        if q["state"] == "running":
            raise ValueError(f"{name} runs already")
        if q["refresh"] != "demand":
            self._begin(name, now=False)
        q["state"] = "running"

    def refresh(self, name: str) -> None:
        """Take in all that is available now."""
        q = self._queries[name]
        if q["state"] != "running":
            raise ValueError(f"{name} is {q['state']}")
        if q["refresh"] == "demand":
            self._begin(name, now=True)
            q["run"].awaitTermination()
        else:
            q["run"].processAllAvailable()

    def pause(self, name: str) -> None:
        """The query stops; what comes meanwhile is taken in when it is resumed."""
        q = self._queries[name]
        if q["run"] is not None and q["run"].isActive:
            q["run"].stop()
        q["state"] = "paused"

    def resume(self, name: str) -> None:
        if self._queries[name]["state"] != "paused":
            raise ValueError(f"{name} is not paused")
        self._queries[name]["state"] = "stopped"
        self.start(name)

    def drop(self, name: str) -> None:
        self.pause(name)
        del self._queries[name]
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def status(self) -> dict[str, tuple[str, int]]:
        """name -> (state, batches so far)."""
        return {n: (q["state"], q["batches"]) for n, q in self._queries.items()}

    def result(self, name: str) -> DataFrame:
        """The table or the files of a query."""
        if self._queries[name]["sink"] == "file":
            return self.spark.read.parquet(f"{self.root}/{name}/out").drop("batch")
        versions = self._versions(name)
        if not versions:
            raise ValueError(f"{name} has no result yet")
        return self.spark.read.parquet(f"{self.root}/{name}/table/v={versions[-1]}")


def lateness(df: DataFrame, ts: str, arrival: str, allowed: str, buffered: str = "0 seconds", keys: Sequence[str] = ()) -> DataFrame:
    """df with watermark (the latest time seen before a row arrived, less the allowed lateness) and handling: on time, buffered (late by no more than the buffer) or dropped.

    What a stream does with each row, told for rows with an order of arrival; keys: sources with a watermark each.
    """
    x, n = in_pieces(df, [*keys, arrival])
    seen = F.max(ts).over(Window.partitionBy(*keys, "_piece").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    if n > 1:  # what the pieces before had seen
        before = F.max("_m").over(Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
        ends = x.groupBy(*keys, "_piece").agg(F.max(ts).alias("_m")).select(*keys, "_piece", before.alias("_before"))
        x = x.alias("l").join(ends.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*keys, "_piece")]).select("l.*", "r._before")
        seen = F.greatest(seen, F.col("_before"))
    out = x.withColumn("watermark", seen - F.expr(f"INTERVAL {allowed}")).select(*df.columns, "watermark")
    late = F.col(ts) < F.col("watermark")
    return out.withColumn("handling", F.when(F.coalesce(late, F.lit(False)) & (F.col(ts) < F.col("watermark") - F.expr(f"INTERVAL {buffered}")), "dropped").when(F.coalesce(late, F.lit(False)), "buffered").otherwise("on time"))


def triggered(df: DataFrame, key: str, ts: str, value: str, count: int | None = None, seconds: float | None = None, keep: int | None = None) -> DataFrame:
    """(key, fired, n, total, first, last): a global window of each key that fires when it has so many rows, or spans so many seconds, whichever comes first.

    keep: how many of the newest rows stay in the window after it fires (eviction); by default none. Rows are
    taken in the order of time within a micro-batch.
    """
    rows = df.select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(value).cast("double").alias("v"))

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        times, values, fired = (list(state.get[0]), list(state.get[1]), state.get[2]) if state.exists else ([], [], 0)
        out = []
        for t, v in pd.concat(list(batches)).sort_values(["t", "v"])[["t", "v"]].itertuples(index=False):
            times.append(int(t))
            values.append(float(v))
            if count is not None and len(times) >= count or seconds is not None and times[-1] - times[0] >= seconds * 1e6:
                fired += 1
                out.append((k[0], fired, len(times), sum(values), times[0], times[-1]))
                times, values = (times[-keep:], values[-keep:]) if keep else ([], [])
        state.update((times, values, fired))
        yield pd.DataFrame(out, columns=["k", "fired", "n", "total", "first", "last"])

    kind = df.schema[key].dataType.simpleString()
    out = rows.groupBy("k").applyInPandasWithState(run, f"k {kind}, fired long, n long, total double, first long, last long", "times array<long>, vs array<double>, fired long", "append", "NoTimeout")
    return out.withColumnRenamed("k", key)


def window_trends(windows: DataFrame, keys: Sequence[str], start: str, value: str, over: int = 6) -> DataFrame:
    """Windows with slope (of the last so many values by least squares), trend (up, down, flat) and forecast (the next value on that line)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(start))
    x = windows.withColumn("_x", n.cast("double"))
    w = Window.partitionBy(*keys).orderBy(start).rowsBetween(-(over - 1), 0)
    mx, my, mxy, mxx = (F.avg(c).over(w) for c in (F.col("_x"), F.col(value), F.col("_x") * F.col(value), F.col("_x") * F.col("_x")))
    slope = (mxy - mx * my) / F.nullif(mxx - mx * mx, F.lit(0.0))
    x = x.withColumns({"slope": slope, "_my": my, "_mx": mx})
    trend = F.when(F.col("slope") > 0, "up").when(F.col("slope") < 0, "down").otherwise("flat")
    return x.withColumns({"trend": trend, "forecast": F.col("_my") + F.coalesce("slope", F.lit(0.0)) * (F.col("_x") + 1 - F.col("_mx"))}).drop("_x", "_my", "_mx")


def custom_window(df: DataFrame, keys: Sequence[str], order: str, opens: Column, closes: Column) -> DataFrame:
    """df with window: numbered from 1, opened by rows that meet a condition and closed by (and with) rows that meet another; rows outside are left out."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    marks = F.when(closes, F.lit(0)).when(opens, F.lit(1))
    x = df.withColumns({"_open": F.coalesce(F.last(marks, ignorenulls=True).over(before), F.lit(0)), "_opens": F.coalesce(opens, F.lit(False))})
    begins = F.col("_opens") & (F.col("_open") == 0)
    x = x.where((F.col("_open") == 1) | F.col("_opens")).withColumn("window", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.drop("_open", "_opens")

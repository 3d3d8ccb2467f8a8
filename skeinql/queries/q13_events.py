"""Continuous queries, late rows, custom and triggered windows, event sourcing, change streams and topics."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinql.queries._base import Registry, table
from skeinql.session import scratch
from skeinql.streaming import continuous as C
from skeinql.streaming import streams as S
from skeinql.streaming.event_store import ChangeLog, EventStore, ReadModel

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _feed(spark: SparkSession, d: str, path: str, k: int, n: int = 3) -> None:
    """Add one of n parts of the events to a folder that a stream reads."""
    table(spark, d, "events").where(F.col("event_id") % n == k).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


@R.add("continuous_table", "SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY user_id")
def continuous_table(spark: SparkSession, d: str) -> DataFrame:
    """A query that is refreshed, paused while rows come, resumed and refreshed again."""
    path, q = scratch(spark, "feed"), C.ContinuousQueries(spark)
    _feed(spark, d, path, 0)
    schema = spark.read.parquet(path).schema
    q.create("totals", lambda: S.file_stream(spark, path, schema).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")), key=["user_id"])
    q.start("totals")
    q.refresh("totals")
    q.pause("totals")
    _feed(spark, d, path, 1)
    q.resume("totals")
    q.refresh("totals")
    _feed(spark, d, path, 2)
    q.refresh("totals")
    return q.result("totals").withColumn("total", F.round("total", 6))


@R.add("continuous_files", "SELECT event_id, value FROM events WHERE event_type = 'purchase'")
def continuous_files(spark: SparkSession, d: str) -> DataFrame:
    """A running query that appends files as rows come."""
    path, q = scratch(spark, "feed"), C.ContinuousQueries(spark)
    _feed(spark, d, path, 0)
    schema = spark.read.parquet(path).schema
    q.create("bought", lambda: S.file_stream(spark, path, schema).where("event_type = 'purchase'").select("event_id", "value"), sink="file", refresh="continuous")
    q.start("bought")
    q.refresh("bought")
    for k in (1, 2):
        _feed(spark, d, path, k)
        q.refresh("bought")
    q.pause("bought")
    return q.result("bought")


@R.add("stream_late_rows", """WITH f AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events WHERE event_id % 10 <> 0 AND event_id <> 1)
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events, f WHERE event_id % 10 <> 0 OR time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR > wm GROUP BY 1""")
def late_rows(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the rows comes after all others: those whose window the watermark has closed are dropped. The watermark of a batch holds from the next but one on, hence the one row in between."""
    path = scratch(spark, "late")
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in (e.where("event_id % 10 <> 0 AND event_id <> 1"), e.where("event_id = 1"), e.where("event_id % 10 = 0")):
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken in the order of their times
    checkpoint = scratch(spark, "late-checkpoint")
    # one file for each micro-batch, the older first
    stream = S.file_stream(spark, path, e.schema, files_per_trigger=1)
    out = S.drain(S.windowed(stream, "ts", "1 hour", {"n": F.count("*")}, late="1 hour"), "update", checkpoint)
    return out.groupBy(F.col("start").cast("timestamp_ntz").alias("start")).agg(F.max("n").alias("n"))


@R.add("stream_lateness", "WITH x AS (SELECT event_id, ts, max(ts) OVER (ORDER BY (event_id * 7919) % 100003, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 5 DAY AS wm FROM events) SELECT CASE WHEN ts < wm - INTERVAL 3 DAY THEN 'dropped' WHEN ts < wm THEN 'buffered' ELSE 'on time' END AS handling, count(*) AS n FROM x GROUP BY 1")
def lateness(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("o", F.struct(((F.col("event_id") * 7919) % 100003).alias("h"), "event_id"))
    return C.lateness(e, "ts", "o", "5 DAYS", "3 DAYS").groupBy("handling").agg(F.count("*").alias("n"))


@R.add("stream_triggered", "WITH x AS (SELECT user_id, value, ts, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, value) - 1) // 5 AS w FROM events) SELECT user_id, CAST(w + 1 AS BIGINT) AS fired, count(*) AS n, round(sum(value), 6) AS total FROM x GROUP BY user_id, w HAVING count(*) = 5")
def triggered(spark: SparkSession, d: str) -> DataFrame:
    """Windows that fire on every fifth row of a user."""
    schema = table(spark, d, "events").schema
    e = S.file_stream(spark, f"{d}/events.parquet*", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    return S.drain(C.triggered(e, "user_id", "ts", "value", count=5), "append").select("user_id", "fired", "n", F.round("total", 6).alias("total"))


@R.add("stream_evicting", "WITH x AS (SELECT user_id, value, row_number() OVER w AS i, sum(value) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, value)) SELECT user_id, CAST((i - 2) // 2 AS BIGINT) AS fired, 4 AS n, round(s, 6) AS total FROM x WHERE i >= 4 AND i % 2 = 0".replace("4 AS n", "CAST(4 AS BIGINT) AS n"))
def evicting(spark: SparkSession, d: str) -> DataFrame:
    """Windows of four rows of which the newest two stay when they fire."""
    schema = table(spark, d, "events").schema
    e = S.file_stream(spark, f"{d}/events.parquet*", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    return S.drain(C.triggered(e, "user_id", "ts", "value", count=4, keep=2), "append").select("user_id", "fired", "n", F.round("total", 6).alias("total"))


@R.add("stream_custom_window", """WITH e AS (SELECT *, struct_pack(a := ts, b := event_id) AS o FROM events), m AS (SELECT *, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN 0 WHEN event_type = 'view' THEN 1 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS is_open FROM e),
x AS (SELECT *, sum(CASE WHEN event_type = 'view' AND is_open = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY o ROWS UNBOUNDED PRECEDING) AS w FROM m WHERE is_open = 1 OR event_type = 'view') SELECT user_id, CAST(w AS BIGINT) AS "window", count(*) AS n FROM x GROUP BY user_id, w""")
def custom_window(spark: SparkSession, d: str) -> DataFrame:
    """Windows from a view to the next purchase."""
    e = table(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    out = C.custom_window(e, ["user_id"], "o", F.col("event_type") == "view", F.col("event_type") == "purchase")
    return out.groupBy("user_id", F.col("window").cast("long").alias("window")).agg(F.count("*").alias("n"))


@R.add("stream_trend_forecast", """WITH h AS (SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, sum(value) AS total FROM events GROUP BY ALL), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY event_type ORDER BY start) AS DOUBLE) AS x FROM h),
s AS (SELECT *, regr_slope(total, x) OVER w AS slope, avg(total) OVER w AS my, avg(x) OVER w AS mx FROM n WINDOW w AS (PARTITION BY event_type ORDER BY start ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT event_type, start, CASE WHEN x = 1 THEN 'flat' WHEN slope > 0 THEN 'up' WHEN slope < 0 THEN 'down' ELSE 'flat' END AS trend, round(CASE WHEN x = 1 THEN my ELSE my + slope * (x + 1 - mx) END, 4) AS forecast FROM s""")
def trend_forecast(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    e = S.file_stream(spark, f"{d}/events.parquet*", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    days = S.drain(S.windowed(e, "ts", "1 day", {"total": F.sum("value")}, ["event_type"]), "complete")
    out = C.window_trends(days, ["event_type"], "start", "total")
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "trend", F.round("forecast", 4).alias("forecast"))


def _orders_store(spark: SparkSession, d: str) -> EventStore:
    o = table(spark, d, "orders")
    store = EventStore(spark, scratch(spark, "events"), "long", "amount double, day date")
    rows = o.select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("kind"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").cast("date").alias("day"))
    for k in range(3):
        store.append(rows.where(F.col("o_orderkey") % 3 == k), "o_custkey", ["o_orderkey"], "kind")
    return store


_FOLD = {"total": ("sum", "body.amount"), "orders": ("count", "version"), "first_day": ("min", "body.day")}


@R.add("event_store_state", "SELECT o_custkey AS stream, count(*) AS version, round(sum(o_totalprice), 2) AS total, count(*) AS orders, min(CAST(o_orderdate AS DATE)) AS first_day FROM orders GROUP BY o_custkey")
def event_state(spark: SparkSession, d: str) -> DataFrame:
    """Streams folded from a snapshot and the events behind it."""
    store = _orders_store(spark, d)
    last = store.folders.pop()
    store.position -= 1
    store.snapshot(_FOLD)
    store.folders.append(last)
    store.position += 1
    return store.state(_FOLD).withColumn("total", F.round("total", 2))


@R.add("event_store_replay", "SELECT y, kind, count(*) AS n FROM (SELECT CAST(year(o_orderdate) AS INT) AS y, o_orderstatus AS kind FROM orders) GROUP BY y, kind")
def event_replay(spark: SparkSession, d: str) -> DataFrame:
    """A read model that is kept up append by append, then rebuilt from the events; both are compared."""
    store = EventStore(spark, scratch(spark, "events"), "long", "amount double, day date")

    def project(before: DataFrame | None, events: DataFrame) -> DataFrame:
        new = events.groupBy(F.year("body.day").alias("y"), "kind").agg(F.count("*").alias("n"))
        return new if before is None else before.unionByName(new).groupBy("y", "kind").agg(F.sum("n").alias("n"))

    model = ReadModel(store, scratch(spark, "model"), project)
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("kind"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").cast("date").alias("day"))
    for k in range(2):
        store.append(rows.where(F.col("o_orderkey") % 2 == k), "o_custkey", ["o_orderkey"], "kind")
        kept = model.catch_up()
    rebuilt = model.rebuild()
    return kept.intersect(rebuilt)


@R.add("event_store_retention", "SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
def event_retention(spark: SparkSession, d: str) -> DataFrame:
    store = _orders_store(spark, d)
    store.retain(F.col("body.day") >= F.lit("1996-01-01").cast("date"))
    return store.events().agg(F.count("*").alias("n"))


@R.add("change_stream_resume", "SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'delete' ELSE 'update' END AS op FROM supplier WHERE s_suppkey % 7 = 0 OR s_suppkey % 5 = 0")
def change_stream(spark: SparkSession, d: str) -> DataFrame:
    """A watcher that has seen the inserts resumes behind them."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    log = ChangeLog(spark, scratch(spark, "changes"), ["s_suppkey"])
    log.record(s.limit(0), s)
    seen = log.watch().agg(F.max("token")).first()[0]
    log.record(s, s.where("s_suppkey % 7 <> 0").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 5 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal"))))
    return log.watch(seen).select("s_suppkey", "op")


@R.add("topic_publish_subscribe", "SELECT event_id FROM events WHERE event_type = 'error'")
def topic(spark: SparkSession, d: str) -> DataFrame:
    """Two publishes, a subscriber with a filter, and its place kept between polls."""
    root, checkpoint = scratch(spark, "topics"), scratch(spark, "subscriber")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    schema = e.withColumn("partition", F.lit(0)).schema
    S.publish(e.where("event_id % 2 = 0"), root, "events", "user_id")
    first = S.drain(S.subscribe(spark, root, "events", schema, F.col("event_type") == "error"), "append", checkpoint)
    S.publish(e.where("event_id % 2 = 1"), root, "events", "user_id")
    second = S.drain(S.subscribe(spark, root, "events", schema, F.col("event_type") == "error"), "append", checkpoint)
    return first.union(second).select("event_id")


@R.add("topic_compaction", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id HAVING max_by(event_type, event_id) <> 'error'")
def compaction(spark: SparkSession, d: str) -> DataFrame:
    """The newest row of each key; keys whose newest row is a tombstone go."""
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("gone"))
    return S.compacted(e, ["user_id"], "event_id", "gone").select("user_id", "event_id")

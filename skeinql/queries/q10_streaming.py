"""Streams of the events file, each held against the batch query that means the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinql.queries._base import Registry, table
from skeinql.streaming import streams as S

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _events(spark: SparkSession, d: str) -> DataFrame:
    """events.parquet as a stream; times are instants in UTC."""
    schema = table(spark, d, "events").schema
    return S.file_stream(spark, f"{d}/events.parquet*", schema).withColumn("ts", F.col("ts").cast("timestamp"))


_local = lambda *cs: [F.col(c).cast("timestamp_ntz").alias(c) for c in cs]


@R.add("stream_tumbling", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = S.drain(S.windowed(_events(spark, d), "ts", "1 hour", {"n": F.count("*"), "total": F.sum("value")}, ["event_type"]), "complete")
    return out.select("event_type", *_local("start"), "n", F.round("total", 6).alias("total"))


@R.add("stream_sliding", "WITH e AS (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) SELECT event_type, start, count(*) AS n FROM e GROUP BY ALL")
def sliding(spark: SparkSession, d: str) -> DataFrame:
    out = S.drain(S.windowed(_events(spark, d), "ts", "2 hours", {"n": F.count("*")}, ["event_type"], slide="1 hour"), "complete")
    return out.select("event_type", *_local("start"), "n")


@R.add("stream_session", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session(spark: SparkSession, d: str) -> DataFrame:
    out = S.drain(S.sessions(_events(spark, d), "ts", "6 hours", {"n": F.count("*")}, ["user_id"]), "complete")
    return out.select("user_id", *_local("start"), "n")


@R.add("stream_filter_map", "SELECT event_id, value * 2 AS twice, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'click' AND value > 50")
def filter_map(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).where("event_type = 'click' AND value > 50")
    return S.drain(e.select("event_id", (F.col("value") * 2).alias("twice"), F.get_json_object("props", "$.k").cast("long").alias("k")))


@R.add("stream_dedup", "SELECT count(*) AS n FROM (SELECT DISTINCT event_id FROM events)")
def dedup(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return S.drain(S.deduplicated(e.union(e), "ts", ["event_id"], "60 days")).agg(F.count("*").alias("n"))


@R.add("stream_join", "SELECT a.event_id AS left_event_id, b.event_id AS right_event_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000")
def join(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("event_id", "user_id", "ts", "event_type")
    out = S.interval_join(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), ["user_id"], "ts", "ts", "1 HOUR", "60 days")
    return S.drain(out.select("left_event_id", "right_event_id"))


@R.add("stream_union", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def union(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return S.drain(e.where("event_type = 'view'").union(e.where("event_type = 'click'")).groupBy("event_type").agg(F.count("*").alias("n")), "complete")


@R.add("stream_top_n", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_n(spark: SparkSession, d: str) -> DataFrame:
    return S.drain(_events(spark, d).groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(5), "complete")


@R.add("stream_latest", "SELECT user_id, max_by(event_id, ts) AS event_id FROM events GROUP BY 1")
def latest(spark: SparkSession, d: str) -> DataFrame:
    return S.drain(S.latest(_events(spark, d), ["user_id"], "ts"), "complete").select("user_id", "event_id")


@R.add("stream_aggregates", "SELECT event_type, count(*) AS n, round(avg(value), 9) AS mean, min(value) AS lo, max(value) AS hi, min_by(event_id, ts) AS first_id, max_by(event_id, ts) AS last_id FROM events GROUP BY 1")
def aggregates(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return S.drain(e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.min_by("event_id", "ts").alias("first_id"), F.max_by("event_id", "ts").alias("last_id")), "complete")


@R.add("stream_anomalies", "SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS start, count(value) AS n FROM events GROUP BY ALL HAVING stddev_pop(value) > 0 AND (max(value) - avg(value)) / stddev_pop(value) > 3")
def anomalies(spark: SparkSession, d: str) -> DataFrame:
    out = S.drain(S.anomalies(_events(spark, d), "ts", "value", ["event_type"], "6 hours"), "complete")
    return out.select("event_type", *_local("start"), "n")


@R.add("stream_alerts", "SELECT event_id, unnest(list_filter([CASE WHEN value > 150 THEN 'high' END, CASE WHEN event_type = 'error' THEN 'error' END], lambda x: x IS NOT NULL)) AS alert FROM events")
def alerts(spark: SparkSession, d: str) -> DataFrame:
    return S.drain(S.alerts(_events(spark, d), {"high": F.col("value") > 150, "error": F.col("event_type") == "error"}).select("event_id", "alert"))


@R.add("stream_stateful_sequence", "SELECT user_id AS k, count(*) FILTER (WHERE event_type = 'purchase' AND before = 'view') AS matches FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id, event_type IN ('view', 'purchase') ORDER BY ts) AS before FROM events) GROUP BY user_id")
def stateful(spark: SparkSession, d: str) -> DataFrame:
    return S.drain(S.sequence_counts(_events(spark, d), "user_id", "ts", F.col("event_type") == "view", F.col("event_type") == "purchase"), "update")

"""Indexes, encodings, partition maintenance and shards."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinql.operators import indexes as I
from skeinql.operators import partitioning as P
from skeinql.queries._base import Registry, table
from skeinql.session import scratch

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.add("bitmap_logic", "SELECT o_orderkey FROM orders WHERE (o_orderstatus IN ('F', 'P') OR o_orderpriority = '1-URGENT') AND NOT o_orderpriority = '5-LOW'")
def bitmap_logic(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    status, priority = I.bitmap_index(o, "o_orderkey", "o_orderstatus"), I.bitmap_index(o, "o_orderkey", "o_orderpriority")
    some = I.bitmap_or(I.bitmap(status, "F", "P"), I.bitmap(priority, "1-URGENT"))
    return I.bitmap_rows(I.bitmap_and(some, I.bitmap_not(I.bitmap(priority, "5-LOW"), I.all_rows(o, "o_orderkey")))).withColumnRenamed("row", "o_orderkey")


@R.add("bitmap_counts", "SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY o_orderstatus")
def bitmap_counts(spark: SparkSession, d: str) -> DataFrame:
    return I.bitmap_index(table(spark, d, "orders"), "o_orderkey", "o_orderstatus").groupBy("value").agg(F.sum(F.bit_count("bits")).cast("long").alias("n"))


@R.add("bitmap_range", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 200000")
def bitmap_range(spark: SparkSession, d: str) -> DataFrame:
    index = I.range_bitmaps(table(spark, d, "orders"), "o_orderkey", "o_totalprice", [50000.0, 100000.0, 200000.0, 400000.0])
    return I.bitmap_rows(I.range_rows(index, 100000.0, 200000.0)).withColumnRenamed("row", "o_orderkey")


@R.add("index_covering", "SELECT o_custkey, sum(o_totalprice) AS total FROM orders WHERE o_custkey BETWEEN 10 AND 40 GROUP BY o_custkey")
def index_covering(spark: SparkSession, d: str) -> DataFrame:
    index = I.CoveringIndex(spark, scratch(spark, "covering"), {"o_custkey": "o_custkey"}, ["o_totalprice"]).build(table(spark, d, "orders"))
    return index.find("o_custkey BETWEEN 10 AND 40").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))


@R.add("index_partial_expression", "SELECT o_orderkey, year(o_orderdate) AS y FROM orders WHERE o_orderstatus = 'P' AND year(o_orderdate) = 1995")
def index_partial(spark: SparkSession, d: str) -> DataFrame:
    index = I.CoveringIndex(spark, scratch(spark, "partial"), {"y": "CAST(year(o_orderdate) AS BIGINT)"}, ["o_orderkey"], where="o_orderstatus = 'P'").build(table(spark, d, "orders"))
    return index.find("y = 1995", ["o_orderkey", "y"])


@R.add("index_lsm", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 10 = 0")
def index_lsm(spark: SparkSession, d: str) -> DataFrame:
    """Rows are put, changed and deleted in seven runs, with merges in between; some of the deleted come back."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    changed = c.withColumn("c_acctbal", F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    lsm = I.LsmIndex(spark, scratch(spark, "lsm"), "c_custkey", "c_custkey long, c_acctbal double", runs=3)
    for k in range(4):
        lsm.put(c.where(F.col("c_custkey") % 4 == k))
    lsm.put(changed.where("c_custkey % 3 = 0"))
    lsm.delete(c.where("c_custkey % 5 = 0"))
    lsm.put(changed.where("c_custkey % 10 = 0"))
    return lsm.scan()


@R.add("encode_dictionary", "WITH c AS (SELECT o_orderpriority AS value, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS code FROM orders GROUP BY 1) SELECT o_orderkey, CAST(code AS INT) AS code FROM orders JOIN c ON value = o_orderpriority")
def encode_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return I.dictionary_encoded(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")[0].select("o_orderkey", "code")


@R.add("encode_run_length", "WITH x AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM x) SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS value, count(*) AS length FROM y GROUP BY user_id, run")
def encode_runs(spark: SparkSession, d: str) -> DataFrame:
    return I.run_lengths(table(spark, d, "events"), ["user_id"], "event_id", "event_type").withColumn("run", F.col("run").cast("long"))


@R.add("encode_delta", "SELECT event_id, event_id - coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS delta, event_id AS back FROM events")
def encode_delta(spark: SparkSession, d: str) -> DataFrame:
    x = I.deltas(table(spark, d, "events"), ["user_id"], "event_id", "event_id")
    return x.select("event_id", "delta", I.from_deltas(x, ["user_id"], "event_id").alias("back"))


@R.add("encode_frame", "SELECT l_shipmode, min(l_partkey) AS base, CAST(CASE WHEN max(l_partkey) = min(l_partkey) THEN 0 ELSE length(bin(max(l_partkey) - min(l_partkey))) END AS INT) AS width FROM lineitem GROUP BY l_shipmode".replace("l_shipmode", "l_returnflag"))
def encode_frame(spark: SparkSession, d: str) -> DataFrame:
    return I.framed(table(spark, d, "lineitem"), ["l_returnflag"], "l_partkey")


@R.add("encode_choice", """WITH x AS (SELECT o_custkey AS v, lag(o_custkey) OVER (ORDER BY o_orderkey) AS p FROM orders), s AS (SELECT count(*) AS n, count(DISTINCT v) AS d, count(*) FILTER (WHERE v IS DISTINCT FROM p) AS runs, min(v) AS lo, max(v) AS hi, max(abs(v - p)) AS step FROM x)
SELECT 'plain' AS encoding, n * 8 AS bytes FROM s UNION ALL SELECT 'dictionary', d * 8 + CAST(ceil(n * length(bin(greatest(d - 1, 1))) / 8) AS BIGINT) FROM s UNION ALL SELECT 'run-length', runs * 12 FROM s UNION ALL SELECT 'frame of reference', 8 + CAST(ceil(n * length(bin(greatest(hi - lo, 1))) / 8) AS BIGINT) FROM s UNION ALL SELECT 'delta', 8 + CAST(ceil(n * (length(bin(greatest(step, 1))) + 1) / 8) AS BIGINT) FROM s""")
def encode_choice(spark: SparkSession, d: str) -> DataFrame:
    return I.best_encoding(table(spark, d, "orders"), "o_custkey", "o_orderkey")


@R.add("partition_maintenance", "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01' AND o_orderdate < TIMESTAMP '1996-03-01' AND NOT (o_orderdate >= TIMESTAMP '1995-10-01' AND o_orderdate < TIMESTAMP '1996-01-01') GROUP BY 1")
def partition_maintenance(spark: SparkSession, d: str) -> DataFrame:
    """Yearly partitions made ahead, one split in quarters of a kind, one of these dropped, the others merged."""
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_orderkey")
    parts, date = P.RangePartitions(spark, scratch(spark, "ranges"), "day"), datetime.date
    parts.add_periods(date(1990, 5, 1), 15, "year")
    parts.insert(o)
    parts.split(date(1995, 1, 1), date(1995, 6, 1))
    parts.split(date(1995, 6, 1), date(1995, 10, 1))
    parts.drop(date(1995, 10, 1))
    parts.merge(date(1995, 1, 1), date(1995, 10, 1))
    return parts.read(date(1995, 6, 1), date(1996, 3, 1)).groupBy("day").agg(F.count("*").alias("n"))


@R.add("shard_query", "SELECT c_mktsegment, count(*) AS n, (SELECT count(*) FROM customer WHERE c_nationkey IN (3, 7)) AS routed FROM customer GROUP BY c_mktsegment")
def shard_query(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    shards = P.ShardMap(spark, [scratch(spark, f"shard{n}") for n in range(4)], "c_nationkey")
    shards.write(c)
    routed = shards.read(3, 7).agg(F.count("*").alias("routed"))
    return shards.read().groupBy("c_mktsegment").agg(F.count("*").alias("n")).crossJoin(F.broadcast(routed))


@R.add("layout_advice", "SELECT 'l_shipdate' AS \"column\", 'range-sorted' AS layout, 3 AS uses UNION ALL SELECT 'l_partkey', 'bloom filter', 2")
def layout_advice(spark: SparkSession, d: str) -> DataFrame:
    log = [("l_shipdate", "<"), ("l_shipdate", ">="), ("l_partkey", "="), ("l_shipdate", "between"), ("l_partkey", "="), ("l_tax", "=")]
    return spark.createDataFrame(P.advise(log), "column string, layout string, uses int")

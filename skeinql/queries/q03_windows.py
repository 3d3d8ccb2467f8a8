"""Window functions, frames, and frames that Spark has no syntax for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinql.operators import windows as W
from skeinql.queries._base import Registry, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
S = R.sql
P = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"

S("window_ranking", "orders", f"SELECT o_orderkey, row_number() {P}) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr, ntile(4) {P}) AS nt FROM orders")
S("window_distribution", "orders", f"SELECT o_orderkey, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus), 6) AS pr, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus), 6) AS cd FROM orders")
S("window_lead_lag", "orders", f"SELECT o_orderkey, lag(o_totalprice, 1, 0.0) {P}) AS prev, lead(o_totalprice, 2) {P}) AS next2 FROM orders")
S("window_values", "orders", f"SELECT o_orderkey, first_value(o_orderkey) {P} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f, last_value(o_orderkey) {P} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) {P} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n2 FROM orders")
S("window_running", "orders", f"SELECT o_orderkey, round(sum(o_totalprice) {P} ROWS UNBOUNDED PRECEDING), 2) AS run, count(*) {P} ROWS UNBOUNDED PRECEDING) AS n, min(o_totalprice) {P} ROWS UNBOUNDED PRECEDING) AS mn, max(o_totalprice) {P} ROWS UNBOUNDED PRECEDING) AS mx FROM orders".replace("ROWS UNBOUNDED PRECEDING", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"))
S("window_sliding", "orders", f"SELECT o_orderkey, round(avg(o_totalprice) {P} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS m, round(sum(o_totalprice) {P} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 2) AS later FROM orders")
S("window_spread", "orders", f"SELECT o_orderkey, round(stddev_pop(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS sd, round(var_pop(o_totalprice) OVER (PARTITION BY o_custkey), 0) AS v FROM orders")
S("window_range_frame", "events", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS last_hour FROM events")
S("window_nulls_order", "orders customer", "SELECT c_custkey, row_number() OVER (ORDER BY o NULLS FIRST, c_custkey) AS a, row_number() OVER (ORDER BY o DESC NULLS LAST, c_custkey) AS b FROM (SELECT c_custkey, max(o_orderkey) AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) t")
S("window_share", "orders", "SELECT o_orderstatus, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 6) AS share FROM orders GROUP BY o_orderstatus")


@R.add("window_groups_frame", f"SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM orders")
def groups_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return W.over_groups(o, ["o_custkey"], ["o_orderpriority"], -1, 1, {"n": F.count("*")}).select("o_orderkey", "n")


@R.add("window_exclude", f"""SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW), 2) AS no_row,
round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP), 2) AS no_group,
round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES), 2) AS no_ties FROM orders""")
def exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    for kind, name in (("current row", "no_row"), ("group", "no_group"), ("ties", "no_ties")):
        o = o.withColumn(name, F.round(W.sum_excluding("o_totalprice", ["o_custkey"], ["o_orderpriority"], kind), 2))
    return o.select("o_orderkey", "no_row", "no_group", "no_ties")


@R.add("window_builder", f"SELECT o_orderkey, round(avg(o_totalprice) {P} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS centered FROM orders")
def builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = W.WindowBuilder().partition_by("o_custkey").order_by("o_orderdate", "o_orderkey").centered(2)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.avg("o_totalprice").over(spec.build()), 6).alias("centered"))

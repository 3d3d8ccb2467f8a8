"""Scans, expressions, joins, aggregation, sorting, set operations, subqueries and CTEs over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinql.operators import joins
from skeinql.operators import timeseries as T
from skeinql.queries._base import Registry, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
S = R.sql

# --- headline joins -------------------------------------------------------------------------------
S("tpch_q3", "customer orders lineitem", """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")
S("tpch_q4", "orders lineitem", """
SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)
GROUP BY o_orderpriority""")
S("tpch_q5", "customer orders lineitem supplier nation region", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
S("tpch_q6", "lineitem", """
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
S("tpch_q7", "supplier lineitem orders customer nation", """
SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(YEAR FROM l_shipdate) AS INT) AS l_year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey WHERE n1.n_nationkey < 3 AND n2.n_nationkey < 3 AND n1.n_nationkey <> n2.n_nationkey
GROUP BY n1.n_name, n2.n_name, extract(YEAR FROM l_shipdate)""")
S("tpch_q10", "customer orders lineitem nation", """
SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, n_name FROM customer JOIN orders ON c_custkey = o_custkey
JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
S("tpch_q12", "orders lineitem", """
SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_returnflag""")
S("tpch_q13", "customer orders", """
SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 1000 GROUP BY c_custkey) t GROUP BY c_count""")
S("tpch_q14", "lineitem part", """
SELECT round(100.0 * sum(CASE WHEN p_size > 25 THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 4) AS big_part_share FROM lineitem JOIN part ON l_partkey = p_partkey""")
S("tpch_q15", "lineitem supplier", """
WITH revenue AS (SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total FROM lineitem GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total FROM supplier JOIN revenue ON s_suppkey = l_suppkey WHERE total = (SELECT max(total) FROM revenue)""")
S("tpch_q17", "lineitem part", """
SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_size < 10 AND l_quantity < (SELECT 0.5 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)""")
S("tpch_q18", "customer orders lineitem", """
SELECT c_custkey, o_orderkey, o_totalprice, sum(l_quantity) AS qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 220) GROUP BY c_custkey, o_orderkey, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
S("tpch_q19", "lineitem part", """
SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE (p_size BETWEEN 1 AND 5 AND l_quantity BETWEEN 1 AND 11) OR (p_size BETWEEN 6 AND 15 AND l_quantity BETWEEN 10 AND 20)""")
S("tpch_q21", "supplier lineitem orders", """
SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey WHERE o_orderstatus = 'F'
AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_quantity > 40) GROUP BY s_name""")
S("tpch_q22", "customer orders", """
SELECT c_mktsegment, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer
WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-01-01') GROUP BY c_mktsegment""")

# --- scan, projection, predicates -----------------------------------------------------------------
S("scan_project", "orders", "SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders")
S("select_distinct", "orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
S("case_searched", "orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
S("case_simple", "orders", "SELECT o_orderstatus, count(*) AS n, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS label FROM orders GROUP BY o_orderstatus")
S("between_in", "part", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') AND p_size NOT BETWEEN 14 AND 15 AND p_brand NOT IN ('Brand#12')")
S("is_null", "orders customer", "SELECT c_custkey, o_orderkey IS NULL AS without_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000 WHERE o_orderkey IS NULL OR c_mktsegment IS NULL")
S("like_patterns", "part", "SELECT p_partkey, p_name LIKE '%a%' AS has_a, p_name NOT LIKE 'b_%' AS not_b FROM part")
S("ilike_patterns", "part", "SELECT p_partkey, p_name ILIKE '%A%' AS has_a FROM part")
S("arithmetic", "lineitem", "SELECT l_orderkey, l_linenumber, round(l_extendedprice + l_tax, 6) AS a, round(l_extendedprice - l_tax, 6) AS b, round(l_extendedprice * l_tax, 6) AS c, round(l_extendedprice / l_quantity, 9) AS d, l_orderkey % 7 AS e, -l_linenumber AS f FROM lineitem")
S("comparisons", "lineitem", "SELECT l_linenumber, count(*) AS n, sum(CASE WHEN l_quantity = 10 THEN 1 ELSE 0 END) AS eq, sum(CASE WHEN l_quantity <> 10 THEN 1 ELSE 0 END) AS ne, sum(CASE WHEN l_quantity <= 10 THEN 1 ELSE 0 END) AS le, sum(CASE WHEN l_quantity > 10 AND NOT (l_tax >= 0.05 OR l_discount < 0.02) THEN 1 ELSE 0 END) AS logic FROM lineitem GROUP BY l_linenumber")
S("three_valued_logic", "orders customer", "SELECT count(*) AS n, count(CASE WHEN o_totalprice > 0 AND NULL IS NULL THEN 1 END) AS a, count(CASE WHEN (o_totalprice > 100000) OR (CAST(NULL AS BOOLEAN)) THEN 1 END) AS b, count(CASE WHEN NOT ((o_totalprice > 100000) AND CAST(NULL AS BOOLEAN)) THEN 1 END) AS c FROM orders")
S("cast_types", "orders", "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS whole, CAST(o_orderkey AS VARCHAR(20)) AS text, CAST(o_orderdate AS DATE) AS day FROM orders", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS whole, CAST(o_orderkey AS VARCHAR) AS text, CAST(o_orderdate AS DATE) AS day FROM orders")
S("string_match_kinds", "part", "SELECT p_partkey, p_type = 'TIN' AS exact_match, startswith(p_name, 'p') AS prefix_match, endswith(p_name, 'e') AS suffix_match, contains(p_name, 'ar') AS contains_match, lower(p_brand) = 'brand#11' AS nocase_match FROM part", "SELECT p_partkey, p_type = 'TIN' AS exact_match, starts_with(p_name, 'p') AS prefix_match, ends_with(p_name, 'e') AS suffix_match, contains(p_name, 'ar') AS contains_match, lower(p_brand) = 'brand#11' AS nocase_match FROM part")
S("regex_match", "part", "SELECT p_partkey FROM part WHERE p_name RLIKE '^[a-m].*[0-9a-z]$'", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^[a-m].*[0-9a-z]$')")
S("constant_folding", "nation", "SELECT n_nationkey, (1 + 2) * 3 AS nine, 'a' || 'b' AS ab, true AND false AS no FROM nation")

# --- joins ----------------------------------------------------------------------------------------
for _how, _word in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    S(f"join_{_how}", "customer orders", f"SELECT c_custkey, o_orderkey FROM customer c {_word} (SELECT * FROM orders WHERE o_totalprice > 150000) o ON c_custkey = o_custkey")
S("join_cross", "region nation", "SELECT r_name, n_name FROM region CROSS JOIN nation")
S("join_semi", "customer orders", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
S("join_anti", "customer orders", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000")
for _hint in ("BROADCAST", "MERGE", "SHUFFLE_HASH", "SHUFFLE_REPLICATE_NL"):
    S(f"join_hint_{_hint.lower()}", "supplier nation", f"SELECT /*+ {_hint}(n) */ s_suppkey, n_name FROM supplier s JOIN nation n ON s_nationkey = n_nationkey")
S("join_theta", "supplier nation", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey AND s_acctbal > 5000 AND n_nationkey > 20")
S("join_self_duplicates", "nation", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
S("join_null_keys", "nation", "SELECT count(*) AS n FROM (SELECT CASE WHEN n_nationkey > 5 THEN n_nationkey END AS k FROM nation) a JOIN (SELECT CASE WHEN n_nationkey > 10 THEN n_nationkey END AS k FROM nation) b ON a.k = b.k")
S("join_int64_segments", "nation", "SELECT count(*) AS matches FROM (SELECT id AS k FROM range(0, 100)) b JOIN (SELECT id AS k FROM range(50, 150)) p ON b.k = p.k", "SELECT count(*) AS matches FROM range(0, 100) b(k) JOIN range(50, 150) p(k) ON b.k = p.k")


@R.add("join_asof", """SELECT e.event_id, e.user_id, p.event_id AS last_purchase FROM events e ASOF LEFT JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_purchase"))
    return joins.asof_join(e, bought, ["user_id"], "ts", "ts", ["last_purchase"]).select("event_id", "user_id", "last_purchase")


@R.add("join_interval", """SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000""")
def join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    a, b = (e.select(F.col("event_id").alias(x), "user_id", F.col("ts").alias(f"t{x}")) for x in "ab")
    return joins.interval_join(a, b.withColumnRenamed("user_id", "user_id"), ["user_id"], "ta", "tb", 3600).where("a < b").select("a", "b")


@R.add("join_range", "SELECT o_orderkey, band FROM orders JOIN (SELECT range AS band, range * 50000.0 AS low, (range + 1) * 50000.0 AS high FROM range(0, 12)) r ON o_totalprice >= low AND o_totalprice < high")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.range(12).select(F.col("id").alias("band"), (F.col("id") * 50000.0).alias("low"), ((F.col("id") + 1) * 50000.0).alias("high"))
    return joins.range_join(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), bands, "o_totalprice", "low", "high", 50000.0).select("o_orderkey", "band")


@R.add("join_lookup", "SELECT n_name, len(list(s_suppkey) FILTER (s_suppkey IS NOT NULL)) AS suppliers FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name".replace("len(list(s_suppkey) FILTER (s_suppkey IS NOT NULL))", "count(s_suppkey)"))
def join_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = joins.lookup(table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "n_nationkey", "s_nationkey", "suppliers")
    return found.select("n_name", F.size("suppliers").cast("long").alias("suppliers"))


@R.add("join_salted", "SELECT l_returnflag, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_returnflag")
def join_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_returnflag", "l_linenumber")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    return joins.salted_join(l, o, "k", 8).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@R.add("join_size_checked", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_size_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return joins.small_join(table(spark, sf_dir, "customer"), n, "c_nationkey").groupBy("n_name").agg(F.count("*").alias("n"))


# --- aggregation ----------------------------------------------------------------------------------
S("agg_basic", "lineitem", "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, sum(l_quantity) AS qty, round(avg(l_extendedprice), 4) AS mean, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_returnflag")
S("agg_having", "orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
S("agg_spread", "lineitem", "SELECT l_linestatus, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_quantity), 6) AS vs, round(var_pop(l_quantity), 6) AS vp FROM lineitem GROUP BY l_linestatus")
S("agg_corr", "lineitem", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_pop(l_quantity, l_tax), 6) AS cp, round(covar_samp(l_quantity, l_tax), 6) AS cs, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS icept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
S("agg_bits_bools", "orders", "SELECT o_orderstatus, bit_and(o_orderkey) AS ba, bit_or(o_orderkey) AS bo, bit_xor(o_orderkey) AS bx, bool_and(o_totalprice > 0) AS alls, bool_or(o_totalprice > 400000) AS anys FROM orders GROUP BY o_orderstatus")
@R.add("agg_median_mode", "SELECT l_returnflag, round(median(l_extendedprice), 4) AS med, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, quantile_disc(l_quantity, 0.5) AS lower_median FROM lineitem GROUP BY l_returnflag")
def agg_median_mode(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    price = T.exact_quantiles(l, ["l_returnflag"], "l_extendedprice", {"med": 0.5, "p90": 0.9})
    lower = T.exact_quantiles(l, ["l_returnflag"], "l_quantity", {"lower_median": 0.5}, ["lower_median"])
    both = price.join(lower.withColumnRenamed("l_returnflag", "flag"), F.col("l_returnflag").eqNullSafe(F.col("flag")))
    return both.select("l_returnflag", F.round("med", 4).alias("med"), F.round("p90", 4).alias("p90"), "lower_median")


S("agg_mode", "part", "SELECT p_brand, mode() WITHIN GROUP (ORDER BY p_size) AS m FROM part GROUP BY p_brand", "SELECT p_brand, (SELECT p_size FROM part q WHERE q.p_brand = p.p_brand GROUP BY p_size ORDER BY count(*) DESC, p_size LIMIT 1) AS m FROM part p GROUP BY p_brand")
S("agg_string_agg", "nation", "SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
S("agg_array_agg", "nation", "SELECT n_regionkey, array_join(sort_array(array_agg(n_nationkey)), '-') AS ids FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(list(n_nationkey)), '-') AS ids FROM nation GROUP BY n_regionkey")
S("agg_json", "nation", "SELECT n_regionkey, to_json(sort_array(collect_list(n_name))) AS names, to_json(map_from_entries(sort_array(collect_list(struct(n_name, n_nationkey))))) AS by_name FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(to_json(list_sort(list(n_name))) AS VARCHAR) AS names, chr(123) || string_agg(chr(34) || n_name || chr(34) || ':' || n_nationkey, ',' ORDER BY n_name) || chr(125) AS by_name FROM nation GROUP BY n_regionkey")
S("agg_first_last", "orders", "SELECT o_custkey, min_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS first_order, max_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey", "SELECT o_custkey, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS first_order, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS last_order FROM orders GROUP BY o_custkey")
S("agg_filter", "lineitem", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, round(sum(CASE WHEN l_discount > 0.05 THEN l_extendedprice ELSE 0 END), 2) AS discounted, count_if(l_tax > 0.04) AS taxed FROM lineitem GROUP BY l_returnflag")
S("agg_rollup", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g1, grouping_id(l_returnflag, l_linestatus) AS gid FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g1, grouping_id(l_returnflag, l_linestatus) AS gid FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
S("agg_cube", "lineitem", "SELECT l_returnflag, l_linestatus, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)")
S("agg_grouping_sets", "lineitem", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
S("agg_global_empty", "orders", "SELECT count(*) AS n, sum(o_totalprice) AS s, min(o_orderdate) AS m FROM orders WHERE o_orderkey < 0")

# --- sort, limit, top-k, pagination ----------------------------------------------------------------
S("sort_nulls", "orders customer", "SELECT c_custkey, o FROM (SELECT c_custkey, max(o_orderkey) AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) t ORDER BY o DESC NULLS LAST, c_custkey LIMIT 50")
S("top_k", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
S("limit_offset", "orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
S("keyset_page", "orders", "SELECT o_orderdate, o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01' OR (o_orderdate = TIMESTAMP '1997-01-01' AND o_orderkey > 100) ORDER BY o_orderdate, o_orderkey LIMIT 30")
S("top_k_per_group", "orders", "SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) t WHERE n <= 5")

# --- set operations -------------------------------------------------------------------------------
for _op in ("UNION", "UNION ALL", "INTERSECT", "EXCEPT", "INTERSECT ALL", "EXCEPT ALL"):
    S(f"set_{_op.lower().replace(' ', '_')}", "customer supplier", f"SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 3000 {_op} SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 2000")

# --- subqueries and CTEs --------------------------------------------------------------------------
S("subquery_scalar", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
S("subquery_in", "customer orders", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
S("subquery_not_in", "customer orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
S("subquery_exists", "supplier lineitem", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount > 0.09) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 1000)")
S("subquery_correlated", "orders", "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
S("subquery_lateral", "customer orders", "SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t")
S("subquery_any_all", "supplier customer", "SELECT s_suppkey, s_acctbal > (SELECT min(c_acctbal) FROM customer WHERE c_nationkey = 3) AS gt_any, s_acctbal > (SELECT max(c_acctbal) FROM customer WHERE c_nationkey = 3) AS gt_all, coalesce(s_acctbal > (SELECT max(c_acctbal) FROM customer WHERE c_nationkey = -1), true) AS gt_all_of_none FROM supplier",
  "SELECT s_suppkey, s_acctbal > ANY (SELECT c_acctbal FROM customer WHERE c_nationkey = 3) AS gt_any, s_acctbal > ALL (SELECT c_acctbal FROM customer WHERE c_nationkey = 3) AS gt_all, s_acctbal > ALL (SELECT c_acctbal FROM customer WHERE c_nationkey = -1) AS gt_all_of_none FROM supplier")
S("cte_chain", "orders", "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), b AS (SELECT avg(t) AS m FROM a) SELECT a.o_custkey, round(a.t, 2) AS t FROM a CROSS JOIN b WHERE a.t > 1.5 * b.m")
S("cte_recursive", "nation", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
S("cte_recursive_tree", "nation region", "WITH RECURSIVE edges AS (SELECT 'ROOT' AS parent, r_name AS child FROM region UNION ALL SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey), t AS (SELECT child, 1 AS depth FROM edges WHERE parent = 'ROOT' UNION ALL SELECT e.child, t.depth + 1 FROM t JOIN edges e ON e.parent = t.child) SELECT child, depth FROM t")
S("cte_cycle_guard", "nation", "WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 2) % 25 AS b FROM nation), t AS (SELECT 1 AS node, CAST(',1,' AS STRING) AS seen, 0 AS d UNION ALL SELECT e.b, concat(t.seen, CAST(e.b AS STRING), ','), t.d + 1 FROM t JOIN e ON e.a = t.node WHERE instr(t.seen, concat(',', CAST(e.b AS STRING), ',')) = 0) SELECT node, d FROM t")
S("derived_table", "orders", "SELECT y, max(t) AS best FROM (SELECT extract(YEAR FROM o_orderdate) AS y, o_custkey, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY extract(YEAR FROM o_orderdate), o_custkey) x GROUP BY y")

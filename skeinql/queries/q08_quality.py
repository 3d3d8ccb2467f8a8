"""Quality rules, profiles, constraints, masking, sketches and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinql.operators import approximate as A
from skeinql.operators import quality as Q
from skeinql.operators import timeseries as T
from skeinql.queries._base import Registry, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.add("quality_rules", "WITH s AS (SELECT count(lang) / count(*) AS a, count(DISTINCT lang) / count(*) AS b, count(*) FILTER (WHERE regexp_matches(lang, '^[a-z]{2}$')) / count(lang) AS c, count(*) FILTER (WHERE n_chars BETWEEN 10 AND 5000) / count(n_chars) AS d FROM documents) SELECT rule, round(score, 8) AS score, score >= 0.95 AS passed FROM (SELECT unnest(['complete', 'unique', 'format', 'range']) AS rule, unnest([a, b, c, d]) AS score FROM s)")
def rules(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("lang", "n_chars")
    out = Q.check_rules(t, {"complete": Q.completeness("lang"), "unique": F.coalesce(F.count_distinct("lang") / F.count(F.lit(1)), F.lit(1.0)), "format": Q.format_share("lang", "^[a-z]{2}$"), "range": Q.range_share("n_chars", 10, 5000)})
    return out.withColumn("score", F.round("score", 8))


@R.add("quality_score", "WITH s AS (SELECT 1.0 AS completeness, count(DISTINCT o_orderpriority) / count(*) AS uniqueness, 1.0 AS validity, avg(CASE WHEN o_totalprice > 0 THEN 1.0 ELSE 0 END) AS consistency FROM orders) SELECT round(0.25 * completeness + 0.15 * uniqueness + 0.25 * validity + 0.15 * consistency + 0.15 + 0.05, 8) AS score FROM s")
def score(spark: SparkSession, d: str) -> DataFrame:
    return Q.column_score(table(spark, d, "orders"), "o_orderpriority", F.col("o_orderpriority").rlike("^[0-9A-Z]"), F.col("o_totalprice") > 0).select(F.round("score", 8).alias("score"))


@R.add("profile_columns", "SELECT 'o_orderstatus' AS \"column\", count(*) AS rows, count(*) - count(o_orderstatus) AS nulls, min(o_orderstatus) AS min, max(o_orderstatus) AS max, min(length(o_orderstatus)) AS shortest, max(length(o_orderstatus)) AS longest, 'string' AS inferred FROM orders UNION ALL SELECT 'o_orderkey', count(*), count(*) - count(o_orderkey), CAST(min(o_orderkey) AS VARCHAR), CAST(max(o_orderkey) AS VARCHAR), min(length(CAST(o_orderkey AS VARCHAR))), max(length(CAST(o_orderkey AS VARCHAR))), 'integer' FROM orders")
def profile(spark: SparkSession, d: str) -> DataFrame:
    return Q.profile(table(spark, d, "orders"), ["o_orderstatus", "o_orderkey"]).drop("approx_distinct")


@R.add("profile_top_values", "SELECT p_type AS value, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, value LIMIT 3")
def top_values(spark: SparkSession, d: str) -> DataFrame:
    return Q.top_values(table(spark, d, "part"), "p_type", 3)


@R.add("profile_patterns", r"SELECT regexp_replace(regexp_replace(regexp_replace(p_brand, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g') AS pattern, count(*) AS n FROM part GROUP BY 1")
def patterns(spark: SparkSession, d: str) -> DataFrame:
    return Q.patterns(table(spark, d, "part"), "p_brand")


@R.add("profile_histogram", "WITH m AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 8 AS w FROM orders) SELECT CAST(least(floor((o_totalprice - lo) / w), 7) AS INT) AS bucket, min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS n FROM orders, m GROUP BY 1")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return Q.histogram(table(spark, d, "orders"), "o_totalprice", 8)


@R.add("constraint_foreign_key", "SELECT count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def foreign_key(spark: SparkSession, d: str) -> DataFrame:
    return Q.orphans(table(spark, d, "labels"), "doc_id", table(spark, d, "documents").where("doc_id % 2 = 0"), "doc_id").agg(F.count("*").alias("n"))


@R.add("constraint_unique", "SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def unique(spark: SparkSession, d: str) -> DataFrame:
    return Q.duplicates(table(spark, d, "orders"), ["o_custkey", "o_orderdate"])


@R.add("constraint_check", "SELECT o_orderkey FROM orders WHERE NOT (o_totalprice BETWEEN 1000 AND 400000)")
def check(spark: SparkSession, d: str) -> DataFrame:
    return Q.violations(table(spark, d, "orders"), F.col("o_totalprice").between(1000, 400000)).select("o_orderkey")


@R.add("masking", r"SELECT c_custkey, regexp_replace(c_name, '.', '*', 'g') AS f, repeat('*', length(c_name) - 4) || right(c_name, 4) AS l, left(c_name, 4) || repeat('*', length(c_name) - 4) AS s, sha256('salt' || c_name) AS h, CAST(NULL AS VARCHAR) AS n FROM customer")
def masking(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", *[F.col("c_name").alias(x) for x in "flshn"])
    return Q.masked(c, {"f": ("full",), "l": ("partial_last",), "s": ("partial_first",), "h": ("hash", "salt"), "n": ("nullify",)})


@R.add("masking_formats", "SELECT 'j***@example.com' AS email, '****-****-****-1234' AS card, '***-**-6789' AS ssn, '+* *** ***-4567' AS phone")
def masking_formats(spark: SparkSession, d: str) -> DataFrame:
    one = spark.createDataFrame([("john@example.com", "1234-5678-9012-1234", "123-45-6789", "+1 555 123-4567")], "email string, card string, ssn string, phone string")
    return Q.masked(one, {c: (c,) for c in one.columns})


@R.add("row_policy", "SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR c_acctbal < 0")
def row_policy(spark: SparkSession, d: str) -> DataFrame:
    return Q.secured(table(spark, d, "customer"), {"nation3": F.col("c_nationkey") == 3, "debt": F.col("c_acctbal") < 0, "all": F.lit(True)}, ["nation3", "debt"]).select("c_custkey")


# --- sketches and samples -------------------------------------------------------------------------


@R.add("approx_distinct", "SELECT abs(count(DISTINCT l_partkey) - count(DISTINCT l_partkey)) < 1 AS close FROM lineitem")
def approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Apart, as a sketch beside count(DISTINCT) would be kept for each value."""
    l = table(spark, d, "lineitem")
    one = l.agg(A.approx_distinct("l_partkey").alias("a")).crossJoin(l.agg(F.count_distinct("l_partkey").alias("e")))
    return one.select((F.abs(F.col("a") - F.col("e")) <= 0.05 * F.col("e")).alias("close"))


@R.add("approx_distinct_merge", "SELECT true AS close")
def approx_distinct_merge(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    parts = l.groupBy("l_returnflag").agg(A.distinct_sketch("l_partkey").alias("s"))
    exact = l.agg(F.count_distinct("l_partkey").alias("e"))
    return parts.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("a")).crossJoin(exact).select((F.abs(F.col("a") - F.col("e")) <= 0.05 * F.col("e")).alias("close"))


@R.add("count_min", "SELECT user_id AS key, true AS bounded FROM (SELECT DISTINCT user_id FROM events)")
def count_min(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id")
    exact = e.groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("n"))
    est = A.count_min_estimates(A.count_min(e, "user_id", 0.01, 0.001), e.distinct(), "user_id", 0.01, 0.001)
    total = e.agg(F.count("*").alias("t"))
    return est.join(exact, "key").crossJoin(total).select("key", ((F.col("estimate") >= F.col("n")) & (F.col("estimate") <= F.col("n") + 0.01 * F.col("t"))).alias("bounded"))


@R.add("heavy_hitters", "SELECT l_suppkey AS item, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def heavy_hitters(spark: SparkSession, d: str) -> DataFrame:
    return A.heavy_hitters(table(spark, d, "lineitem"), "l_suppkey", 10)


@R.add("heavy_hitters_approx", "SELECT l_suppkey AS item, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def heavy_hitters_approx(spark: SparkSession, d: str) -> DataFrame:
    """A sketch of the frequencies says which suppliers are counted; of these the ten largest are taken."""
    found = A.heavy_hitters(table(spark, d, "lineitem"), "l_suppkey", 1000, True)
    return found.orderBy(F.desc("count"), "item").limit(10)


@R.add("percentile_interval", "SELECT true AS inside FROM range(1)")
def percentile_interval(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    one = l.agg(A.percentile_interval("l_extendedprice", 0.5).alias("q")).crossJoin(T.exact_quantiles(l, [], "l_extendedprice", {"m": 0.5}))
    return one.select((F.col("m").between(F.col("q.low"), F.col("q.high"))).alias("inside"))


@R.add("sample_systematic", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i % 50 = 7")
def sample_systematic(spark: SparkSession, d: str) -> DataFrame:
    return A.systematic(table(spark, d, "orders").select("o_orderkey"), 50, ["o_orderkey"], 7)


@R.add("sample_stratified", "SELECT o_orderstatus, least(count(*), 20) AS n FROM orders GROUP BY o_orderstatus")
def sample_stratified(spark: SparkSession, d: str) -> DataFrame:
    return A.stratified(table(spark, d, "orders"), "o_orderstatus", 20, ["o_orderkey"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@R.add("sample_reservoir", "SELECT 100 AS n, true AS real")
def sample_reservoir(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey")
    return A.reservoir(o, 100, ["o_orderkey"]).join(o, "o_orderkey", "left_semi").agg(F.count("*").cast("int").alias("n")).withColumn("real", F.col("n") == 100)


@R.add("sample_bernoulli", "SELECT true AS close")
def sample_bernoulli(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return A.bernoulli(o, 0.2, ["o_orderkey"]).agg(F.count("*").alias("n")).crossJoin(o.agg(F.count("*").alias("t"))).select((F.abs(F.col("n") / F.col("t") - 0.2) < 0.03).alias("close"))


@R.add("sample_cluster", "SELECT true AS whole")
def sample_cluster(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    s = A.cluster(o, "o_custkey", 0.1).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return s.join(o.groupBy("o_custkey").agg(F.count("*").alias("t")), "o_custkey").agg(F.bool_and(F.col("n") == F.col("t")).alias("whole"))


@R.add("sample_estimate", "SELECT true AS inside")
def sample_estimate(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    est = A.estimate(A.bernoulli(o, 0.3, ["o_orderkey"], 5), "o_totalprice", 0.3, 4.0)
    return est.crossJoin(o.agg(F.avg("o_totalprice").alias("m"))).select(F.col("m").between(F.col("avg_low"), F.col("avg_high")).alias("inside"))


@R.add("sample_replacement")
def sample_replacement(spark: SparkSession, d: str) -> DataFrame:
    return A.with_replacement(table(spark, d, "orders"), 0.05, 3).agg(F.count("*").alias("n"))

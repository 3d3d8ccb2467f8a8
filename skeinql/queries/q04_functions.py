"""String, math, null, conversion, calendar, array, map and vector functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinql.functions import scalars as M
from skeinql.functions.strings import call, stem
from skeinql.queries._base import Registry, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
S = R.sql

_part = lambda spark, d: table(spark, d, "part")


@R.add("string_basic", "SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS lo, reverse(p_name) AS rev, length(p_name) AS n, strlen(p_name) AS bytes, left(p_name, 4) AS l4, right(p_name, 3) AS r3, ascii(p_name) AS a, chr(65 + p_size % 26) AS ch FROM part")
def string_basic(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    return _part(spark, d).select("p_partkey", call("UPPER", n).alias("up"), call("LOWER", F.col("p_brand")).alias("lo"), call("REVERSE", n).alias("rev"), call("LEN", n).alias("n"), call("DATALENGTH", n).alias("bytes"), call("LEFT", n, 4).alias("l4"), call("RIGHT", n, 3).alias("r3"), call("ASCII", n).alias("a"), call("CHAR", 65 + F.col("p_size") % 26).alias("ch"))


@R.add("string_edit", "SELECT p_partkey, replace(p_name, 'a', 'XX') AS rep, repeat('ab', p_size % 4) AS rpt, translate(p_name, 'aei', '123') AS tr, left(p_name, 1) || 'zz' || substr(p_name, 4) AS stuffed, substr(p_name, 3, 4) AS sub, '[' || p_brand || ']' AS qn, trim('  x ' || p_name || '  ') AS tm, repeat(' ', 3) || 'x' AS sp, concat_ws('-', p_brand, p_type) AS cw, concat(p_brand, NULL, p_type) AS cc FROM part")
def string_edit(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    return _part(spark, d).select(
        "p_partkey", call("REPLACE", n, "a", "XX").alias("rep"), call("REPLICATE", "ab", F.col("p_size") % 4).alias("rpt"), call("TRANSLATE", n, "aei", "123").alias("tr"), call("STUFF", n, 2, 2, "zz").alias("stuffed"), call("SUBSTRING", n, 3, 4).alias("sub"),
        call("QUOTENAME", F.col("p_brand")).alias("qn"), call("TRIM", F.concat(F.lit("  x "), n, F.lit("  "))).alias("tm"), F.concat(call("SPACE", 3), F.lit("x")).alias("sp"), call("CONCAT_WS", "-", F.col("p_brand"), F.col("p_type")).alias("cw"), call("CONCAT", F.col("p_brand"), None, F.col("p_type")).alias("cc"),
    )


@R.add("string_search", "SELECT p_partkey, instr(p_name, 'a') AS ci, CASE WHEN regexp_matches(p_name, 'a.e') THEN length(regexp_extract(p_name, '^(.*?)a.e', 1)) + 1 ELSE 0 END AS pi, levenshtein(p_brand, 'Brand#11') AS lev, contains(p_name, 'o') AS has FROM part")
def string_search(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    return _part(spark, d).select("p_partkey", call("CHARINDEX", "a", n).alias("ci"), call("PATINDEX", "%a_e%", n).alias("pi"), call("LEVENSHTEIN", F.col("p_brand"), "Brand#11").alias("lev"), F.contains(n, F.lit("o")).alias("has"))


@R.add("string_format", "SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS fmt, lpad(printf('%.2f', o_totalprice), 12, ' ') AS st, unicode('é') AS uni, chr(233) AS nch FROM orders")
def string_format(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", call("FORMAT", t, 2).alias("fmt"), call("STR", t, 12, 2).alias("st"), call("UNICODE", "é").alias("uni"), call("NCHAR", F.lit(233)).alias("nch"))


def _soundex(x: str) -> str:
    codes = f"translate(regexp_replace(upper({x}), '[^A-Z]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202')"
    for k in range(7):
        codes = f"regexp_replace({codes}, '{k}+', '{k}', 'g')"
    return f"rpad(left(regexp_replace(upper({x}), '[^A-Z]', '', 'g'), 1) || replace(substr({codes}, 2), '0', ''), 4, '0')"


@R.add("string_soundex", f"WITH c AS (SELECT p_partkey, {_soundex('p_name')} AS code, {_soundex('p_type')} AS other FROM part) SELECT p_partkey, code, CAST(list_sum(list_transform([1, 2, 3, 4], lambda i: CASE WHEN code[i] = other[i] THEN 1 ELSE 0 END)) AS INT) AS diff FROM c")
def string_soundex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", call("SOUNDEX", F.col("p_name")).alias("code"), call("DIFFERENCE", F.col("p_name"), F.col("p_type")).alias("diff"))


@R.add("string_stem", r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)
SELECT w, CASE WHEN ends_with(w, 'ing') AND length(w) > 5 THEN left(w, length(w) - 3) WHEN ends_with(w, 'ed') AND length(w) > 4 THEN left(w, length(w) - 2) WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END AS stem FROM w""")
def string_stem(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    return words.select("w", stem(F.col("w")).alias("stem"))


@R.add("math_functions", "SELECT o_orderkey, abs(-o_totalprice) AS a, CAST(ceil(o_totalprice) AS BIGINT) AS c, CAST(floor(o_totalprice) AS BIGINT) AS f, round(o_totalprice, 1) AS r, trunc(o_totalprice * 1.0) AS t, round(power(o_orderkey, 2), 2) AS p, round(sqrt(o_totalprice), 6) AS s, o_orderkey % 7 AS m, CAST(sign(o_totalprice - 100000) AS DOUBLE) AS sg FROM orders")
def math_functions(spark: SparkSession, d: str) -> DataFrame:
    t, k, f = F.col("o_totalprice"), F.col("o_orderkey"), M.SCALAR_FUNCTIONS
    return table(spark, d, "orders").select(
        "o_orderkey", f["ABS"](-t).alias("a"), f["CEIL"](t).alias("c"), f["FLOOR"](t).alias("f"), f["ROUND"](t, 1).alias("r"), f["TRUNC"](t).alias("t"), F.round(f["POWER"](k, 2), 2).alias("p"), F.round(f["SQRT"](t), 6).alias("s"), f["MOD"](k, 7).alias("m"), f["SIGN"](t - 100000).alias("sg"))


@R.add("null_functions", "SELECT c_custkey, coalesce(o, -1) AS nvl, CASE WHEN o IS NOT NULL THEN 'has' ELSE 'none' END AS nvl2, nullif(c_nationkey, 3) AS ni, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE '?' END AS dec, greatest(c_custkey, c_nationkey) AS g, least(c_custkey, c_nationkey) AS l FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def null_functions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("o"))
    f, c = M.SCALAR_FUNCTIONS, F.col
    return table(spark, d, "customer").join(o, "c_custkey", "left").select("c_custkey", f["NVL"](c("o"), -1).alias("nvl"), f["NVL2"](c("o"), "has", "none").alias("nvl2"), f["NULLIF"](c("c_nationkey"), 3).alias("ni"), f["DECODE"](c("c_mktsegment"), "BUILDING", "B", "MACHINERY", "M", "?").alias("dec"), f["GREATEST"](c("c_custkey"), c("c_nationkey")).alias("g"), f["LEAST"](c("c_custkey"), c("c_nationkey")).alias("l"))


S("conversions", "orders", "SELECT o_orderkey, CAST(o_orderkey AS STRING) AS ch, CAST(concat(CAST(o_orderkey AS STRING), '.5') AS DOUBLE) AS num, try_cast(o_orderstatus AS INT) AS bad, to_date('2024-02-29') AS d FROM orders", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS ch, CAST(o_orderkey || '.5' AS DOUBLE) AS num, TRY_CAST(o_orderstatus AS INT) AS bad, DATE '2024-02-29' AS d FROM orders")
S("calendar", "orders", "SELECT o_orderkey, extract(YEAR FROM o_orderdate) AS y, extract(MONTH FROM o_orderdate) AS m, extract(QUARTER FROM o_orderdate) AS q, dayofyear(o_orderdate) AS doy, CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS month_start, date_add(CAST(o_orderdate AS DATE), 30) AS later, datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS days, last_day(CAST(o_orderdate AS DATE)) AS month_end FROM orders",
  "SELECT o_orderkey, extract(YEAR FROM o_orderdate) AS y, extract(MONTH FROM o_orderdate) AS m, extract(QUARTER FROM o_orderdate) AS q, dayofyear(o_orderdate) AS doy, CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS month_start, CAST(o_orderdate AS DATE) + 30 AS later, DATE '2000-01-01' - CAST(o_orderdate AS DATE) AS days, last_day(CAST(o_orderdate AS DATE)) AS month_end FROM orders")
S("array_functions", "events", "SELECT user_id, size(a) AS n, array_join(slice(a, 1, 3), ',') AS first3, array_contains(a, 10) AS has10, array_max(a) AS mx, aggregate(a, CAST(0 AS BIGINT), (s, x) -> s + x) AS total, size(filter(a, x -> x % 2 = 0)) AS evens, array_join(transform(slice(a, 1, 2), x -> x * 2), ',') AS doubled, exists(a, x -> x > 900) AS big FROM (SELECT user_id, sort_array(collect_list(event_id)) AS a FROM events GROUP BY user_id) t",
  "SELECT user_id, CAST(len(a) AS INT) AS n, array_to_string(a[1:3], ',') AS first3, list_contains(a, 10) AS has10, list_max(a) AS mx, CAST(list_sum(a) AS BIGINT) AS total, CAST(len(list_filter(a, lambda x: x % 2 = 0)) AS INT) AS evens, array_to_string(list_transform(a[1:2], lambda x: x * 2), ',') AS doubled, len(list_filter(a, lambda x: x > 900)) > 0 AS big FROM (SELECT user_id, list_sort(list(event_id)) AS a FROM events GROUP BY user_id) t")
S("map_functions", "events", "SELECT user_id, array_join(map_keys(m), ',') AS ks, array_join(map_values(m), ',') AS vs, m['click'] AS clicks, size(map_filter(m, (k, v) -> v > 20)) AS many FROM (SELECT user_id, map_from_entries(sort_array(collect_list(struct(event_type, n)))) AS m FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) t GROUP BY user_id) u",
  "SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS ks, string_agg(CAST(n AS VARCHAR), ',' ORDER BY event_type) AS vs, max(n) FILTER (WHERE event_type = 'click') AS clicks, CAST(count(*) FILTER (WHERE n > 20) AS INT) AS many FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) t GROUP BY user_id")
S("explode_arrays", "nation", "SELECT n_regionkey, k, pos FROM (SELECT n_regionkey, sort_array(collect_list(n_nationkey)) AS a FROM nation GROUP BY n_regionkey) t LATERAL VIEW posexplode(a) x AS pos, k", "SELECT n_regionkey, unnest(a) AS k, unnest(generate_series(0, len(a) - 1)) AS pos FROM (SELECT n_regionkey, list_sort(list(n_nationkey)) AS a FROM nation GROUP BY n_regionkey) t")


@R.add("vector_math", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT e AS qe FROM v WHERE vec_id = 0)
SELECT vec_id, round(list_dot_product(e, qe), 6) AS dot, round(list_distance(e, qe), 6) AS l2, round(list_cosine_similarity(e, qe), 6) AS cos, round(list_sum(list_transform(list_zip(e, qe), lambda p: abs(p[1] - p[2]))), 6) AS l1 FROM v, q""")
def vector_math(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    q = v.where("vec_id = 0").select(F.col("e").alias("qe"))
    e, x = F.col("e"), F.col("qe")
    return v.crossJoin(F.broadcast(q)).select("vec_id", F.round(M.dot(e, x), 6).alias("dot"), F.round(M.euclidean(e, x), 6).alias("l2"), F.round(M.cosine(e, x), 6).alias("cos"), F.round(M.manhattan(e, x), 6).alias("l1"))


@R.add("function_registry", "SELECT n_nationkey, upper(n_name) AS up, n_nationkey * n_nationkey AS sq FROM nation")
def function_registry(spark: SparkSession, d: str) -> DataFrame:
    """A SQL function and a vectorised one, registered and called by name."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION skein_square(x BIGINT) RETURNS BIGINT RETURN x * x")
    table(spark, d, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_nationkey, upper(n_name) AS up, skein_square(n_nationkey) AS sq FROM nation")

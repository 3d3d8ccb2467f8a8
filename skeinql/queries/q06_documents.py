"""JSON documents, query by example, pipelines and text search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinql.operators import documents as D
from skeinql.operators import textsearch as X
from skeinql.queries._base import Registry, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
S = R.sql

S("json_extract", "events", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, get_json_object(props, '$.none') IS NULL AS missing, json_array_length('[1,2,3]') AS n, array_join(json_object_keys(props), ',') AS ks FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.none') IS NULL AS missing, 3 AS n, array_to_string(json_keys(props), ',') AS ks FROM events")
S("json_build", "nation", "SELECT n_nationkey, to_json(named_struct('id', n_nationkey, 'name', n_name)) AS obj, to_json(array(n_nationkey, n_regionkey)) AS arr FROM nation", "SELECT n_nationkey, CAST(json_object('id', n_nationkey, 'name', n_name) AS VARCHAR) AS obj, CAST(json_array(n_nationkey, n_regionkey) AS VARCHAR) AS arr FROM nation")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """Customers as JSON documents with their orders inside."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"), F.col("o_orderstatus").alias("s")))).alias("orders"))
    c = table(spark, d, "customer").join(o, "c_custkey", "left")
    return c.select("c_custkey", F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("home"), F.col("c_acctbal").alias("balance"), "orders")).alias("doc"))


_C = "c AS (SELECT * FROM customer), o AS (SELECT * FROM orders)"


@R.add("json_value", f"WITH {_C} SELECT c_custkey, c_name AS name, CAST(c_nationkey AS INT) AS nation, c_acctbal AS balance, true AS has_segment FROM c")
def json_value(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc")
    return _docs(spark, d).select("c_custkey", D.json_value(doc, "$.name").alias("name"), D.json_value(doc, "$.home.nation", "int").alias("nation"), D.json_value(doc, "$.balance", "double").alias("balance"), D.json_exists(doc, "$.home.segment").alias("has_segment"))


@R.add("json_path", f"WITH {_C} SELECT c_custkey, count(o_orderkey) FILTER (WHERE o_totalprice > 150000) AS big, count(o_orderkey) AS all_keys, least(count(o_orderkey), 2) AS first_two FROM c LEFT JOIN o ON o_custkey = c_custkey GROUP BY c_custkey")
def json_path(spark: SparkSession, d: str) -> DataFrame:
    n = lambda p: F.coalesce(F.json_array_length(D.json_path(F.col("doc"), p)), F.lit(0)).cast("long")
    return _docs(spark, d).select("c_custkey", n("$.orders[?(@.p > 150000)]").alias("big"), n("$..k").alias("all_keys"), n("$.orders[0:2]").alias("first_two"))


@R.add("json_query", f"WITH {_C} SELECT c_custkey, CAST(json_object('nation', c_nationkey, 'segment', c_mktsegment) AS VARCHAR) AS home, '[' || c_custkey || ']' AS wrapped FROM c")
def json_query(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("c_custkey", D.json_query(F.col("doc"), "$.home").alias("home"), D.json_query(F.col("doc"), "$.id", "with").alias("wrapped"))


@R.add("json_table", f"WITH {_C} SELECT c_custkey, o_orderkey AS k, o_totalprice AS p, o_orderstatus AS s FROM c JOIN o ON o_custkey = c_custkey")
def json_table(spark: SparkSession, d: str) -> DataFrame:
    return D.json_table(_docs(spark, d), "doc", "$.orders[*]", {"k": ("$.k", "long"), "p": ("$.p", "double"), "s": ("$.s", "string")}).drop("doc")


@R.add("json_edit", f"WITH {_C} SELECT c_custkey, 'x' AS was_set, false AS still_there, CAST(c_nationkey AS INT) AS moved, 7 AS merged FROM c")
def json_edit(spark: SparkSession, d: str) -> DataFrame:
    doc = D.json_delete(D.json_set(F.col("doc"), ["home", "note"], "x"), ["balance"])
    doc = D.json_mergepatch(D.json_transform(doc, ("rename", ["home", "nation"], "country")), '{"orders": null, "extra": {"n": 7}}')
    g = lambda p: F.get_json_object(doc, p)
    return _docs(spark, d).select("c_custkey", g("$.home.note").alias("was_set"), (g("$.balance").isNotNull() | g("$.orders").isNotNull()).alias("still_there"), g("$.home.country").cast("int").alias("moved"), g("$.extra.n").cast("int").alias("merged"))


@R.add("json_predicates", f"WITH {_C} SELECT c_custkey, true AS obj, false AS arr, c_mktsegment = 'BUILDING' AS builds, CASE WHEN c_acctbal > 0 THEN 0 ELSE 0 END AS errors FROM c")
def json_predicates(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc")
    return _docs(spark, d).select("c_custkey", D.is_json(doc, "object").alias("obj"), D.is_json(doc, "array").alias("arr"), D.json_contains(doc, '{"home": {"segment": "BUILDING"}}').alias("builds"), F.size(D.schema_errors(doc, ["id", "name"], {"id": "number", "home": "object", "name": "string"})).alias("errors"))


@R.add("json_diff", f"WITH {_C} SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '[{{\"op\":\"replace\",\"path\":\"/id\",\"value\":-1}}]' ELSE '[]' END AS changes FROM c")
def json_diff(spark: SparkSession, d: str) -> DataFrame:
    x = _docs(spark, d).withColumn("after", F.when(F.col("c_custkey") % 2 == 0, D.json_set(F.col("doc"), ["id"], -1)).otherwise(F.col("doc")))
    return x.select("c_custkey", D.json_diff(F.col("doc"), F.col("after")).alias("changes"))


_QBE = {
    "eq": ({"home.segment": "BUILDING"}, "c_mktsegment = 'BUILDING'"),
    "range": ({"balance": {"$gte": 1000, "$lt": 5000}}, "c_acctbal >= 1000 AND c_acctbal < 5000"),
    "in": ({"home.nation": {"$in": [1, 3, 5]}, "id": {"$ne": 10}}, "c_nationkey IN (1, 3, 5) AND c_custkey <> 10"),
    "nin_missing": ({"none": {"$nin": [1]}, "missing": {"$exists": False}, "id": {"$mod": [3, 0]}}, "c_custkey % 3 = 0"),
    "or_not": ({"$or": [{"balance": {"$gt": 9000}}, {"home.nation": 7}], "name": {"$not": {"$regex": "00$"}}}, "(c_acctbal > 9000 OR c_nationkey = 7) AND NOT regexp_matches(c_name, '00$')"),
    "nor_type": ({"$nor": [{"balance": {"$lt": 0}}], "id": {"$type": "number"}, "home": {"$type": "object"}}, "NOT c_acctbal < 0"),
    "elem": ({"orders": {"$elemMatch": {"p": {"$gt": 250000}, "s": "O"}}}, "c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'O')"),
    "size": ({"orders": {"$size": 10}}, "c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) = 10)"),
}


def _qbe(name: str, example: dict, sql: str) -> None:
    @R.add(f"qbe_{name}", f"SELECT c_custkey FROM customer WHERE {sql}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _docs(spark, d).where(D.matches(F.col("doc"), example)).select("c_custkey")


for _n, (_e, _s) in _QBE.items():
    _qbe(_n, _e, _s)


@R.add("pipeline_group", "SELECT o_orderstatus AS _id, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus")
def pipeline_group(spark: SparkSession, d: str) -> DataFrame:
    out = D.aggregate(table(spark, d, "orders"), [{"$match": {"o_totalprice": {"$gt": 1000}}}, {"$group": {"_id": "$o_orderstatus", "n": {"$sum": 1}, "total": {"$sum": "$o_totalprice"}, "mean": {"$avg": "$o_totalprice"}, "lo": {"$min": "$o_orderkey"}, "hi": {"$max": "$o_orderkey"}}}, {"$sort": {"_id": 1}}])
    return out.withColumns({"n": F.col("n").cast("long"), "total": F.round("total", 2), "mean": F.round("mean", 6)})


@R.add("pipeline_project", "SELECT o_orderkey, o_totalprice * 2 + 1 AS x, o_orderstatus || '-' || o_orderpriority AS tag, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size FROM orders ORDER BY o_orderkey LIMIT 30 OFFSET 10")
def pipeline_project(spark: SparkSession, d: str) -> DataFrame:
    return D.aggregate(table(spark, d, "orders"), [{"$sort": {"o_orderkey": 1}}, {"$skip": 10}, {"$limit": 30}, {"$addFields": {"x": {"$add": [{"$multiply": ["$o_totalprice", 2]}, 1]}}}, {"$project": {"o_orderkey": 1, "x": 1, "tag": {"$concat": ["$o_orderstatus", "-", "$o_orderpriority"]}, "size": {"$cond": [{"$gt": ["$o_totalprice", 100000]}, "big", "small"]}}}])


@R.add("pipeline_unwind_lookup", "SELECT n_name, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def pipeline_unwind_lookup(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return D.aggregate(table(spark, d, "nation"), [{"$lookup": {"from": "supplier", "localField": "n_nationkey", "foreignField": "s_nationkey", "as": "s"}}, {"$unwind": "$s"}, {"$project": {"n_name": 1, "s_suppkey": "$s.s_suppkey"}}], {"supplier": s})


@R.add("pipeline_facet", "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS f, (SELECT count(*) FROM orders WHERE o_totalprice > 200000) AS big")
def pipeline_facet(spark: SparkSession, d: str) -> DataFrame:
    out = D.aggregate(table(spark, d, "orders"), [{"$facet": {"f": [{"$match": {"o_orderstatus": "F"}}, {"$count": "n"}], "big": [{"$match": {"o_totalprice": {"$gt": 200000}}}, {"$count": "n"}]}}])
    return out.select(F.col("f")[0]["n"].alias("f"), F.col("big")[0]["n"].alias("big"))


@R.add("document_upsert", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier UNION ALL SELECT -1, 0.0")
def document_upsert(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    news = s.where("s_suppkey % 5 = 0").select("s_suppkey").union(spark.range(1).select(F.lit(-1).cast("long"))).withColumn("s_acctbal", F.lit(0.0))
    return D.upsert(s, news, ["s_suppkey"])


@R.add("document_ttl", "SELECT event_id FROM events WHERE ts + INTERVAL 10 DAY <= TIMESTAMP '2024-01-20'")
def document_ttl(spark: SparkSession, d: str) -> DataFrame:
    return D.expired(table(spark, d, "events"), "ts", 10 * 86400, F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id")


S("conversation_nest", "conversations", "SELECT conv_id, count(*) AS turns, array_join(transform(array_sort(collect_list(struct(turn, role))), x -> x.role), '>') AS roles FROM conversations GROUP BY conv_id", "SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id")

# --- text search ----------------------------------------------------------------------------------
_TOK = r"t AS (SELECT p_partkey AS id, unnest(regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+')) AS w FROM part)"


@R.add("search_ranked", f"WITH {_TOK}, h AS (SELECT id, w, count(*) AS tf FROM t WHERE w IN ('blue', 'ring') GROUP BY ALL), df AS (SELECT w, count(*) AS df FROM h GROUP BY w) SELECT id, round(sum(tf * ln((SELECT count(*) FROM part) / df)), 6) AS score FROM h JOIN df USING (w) GROUP BY id")
def search_ranked(spark: SparkSession, d: str) -> DataFrame:
    return X.search(table(spark, d, "part"), "p_partkey", "p_name", ["blue", "ring"]).withColumn("score", F.round("score", 6))


@R.add("search_index", f"WITH {_TOK} SELECT w AS term, count(DISTINCT id) AS docs, count(*) AS uses FROM t GROUP BY w")
def search_index(spark: SparkSession, d: str) -> DataFrame:
    return X.index(table(spark, d, "part"), "p_partkey", "p_name").groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("uses"))


@R.add("search_predicates", r"SELECT p_partkey, contains(lower(p_name), 'blue bolt') AS phrase, regexp_matches(lower(p_name), '\b[bs]\w*t\b') AS wild, (contains(lower(p_name), 'blue') AND NOT contains(lower(p_name), 'bolt')) OR contains(lower(p_name), 'gear') AS bool, regexp_replace(p_name, '\b(blue|red)\b', '<b>\1</b>', 'g') AS marked FROM part")
def search_predicates(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", X.phrase(n, ["blue", "bolt"]).alias("phrase"), (X.wildcard(n, "b*t") | X.wildcard(n, "s*t")).alias("wild"), X.boolean(n, "(blue AND NOT bolt) OR gear").alias("bool"), X.highlight(n, ["blue", "red"]).alias("marked"))


@R.add("search_fuzzy", r"SELECT p_partkey FROM (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '\w+')) AS w FROM part) GROUP BY p_partkey HAVING min(levenshtein(w, 'blu')) <= 1")
def search_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(X.fuzzy(F.col("p_name"), "blu", 1)).select("p_partkey")

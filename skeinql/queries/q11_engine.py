"""Changing tables, views, caches, the query builder, partitions, sources, learning and user functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinql.operators import learning as L
from skeinql.operators import partitioning as P
from skeinql.plans.builder import Query, plan_report
from skeinql.plans.catalog import Catalog, ConstraintError
from skeinql.plans.materialized import AggregateView, ResultCache
from skeinql.queries._base import Registry, table, views
from skeinql.session import scratch
from skeinql.sources import connectors as N

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _catalog(spark: SparkSession, d: str) -> Catalog:
    c = Catalog(spark, scratch(spark, "catalog"))
    c.create_table("supplier", "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double", primary_key=["s_suppkey"], checks={"nation": "s_nationkey >= 0"}, defaults={"s_acctbal": 0.0})
    c.insert("supplier", table(spark, d, "supplier"))
    return c


@R.add("dml_insert", "SELECT s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT 100000, 'new', 0.0")
def dml_insert(spark: SparkSession, d: str) -> DataFrame:
    c = _catalog(spark, d)
    c.insert("supplier", [{"s_suppkey": 100000, "s_name": "new", "s_nationkey": 1}])
    return c.table("supplier").select("s_suppkey", "s_name", "s_acctbal")


@R.add("dml_update", "SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN s_acctbal + 10 ELSE s_acctbal END AS s_acctbal FROM supplier")
def dml_update(spark: SparkSession, d: str) -> DataFrame:
    c = _catalog(spark, d)
    c.update("supplier", {"s_acctbal": F.col("s_acctbal") + 10}, "s_nationkey = 3")
    return c.table("supplier").select("s_suppkey", "s_acctbal")


@R.add("dml_delete", "SELECT s_suppkey FROM supplier WHERE NOT s_acctbal < 0")
def dml_delete(spark: SparkSession, d: str) -> DataFrame:
    c = _catalog(spark, d)
    c.delete("supplier", "s_acctbal < 0")
    return c.table("supplier").select("s_suppkey")


@R.add("dml_merge", "SELECT s_suppkey, CASE WHEN s_suppkey < 10 THEN 1.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def dml_merge(spark: SparkSession, d: str) -> DataFrame:
    c = _catalog(spark, d)
    c.merge("supplier", table(spark, d, "supplier").where("s_suppkey < 10").withColumn("s_acctbal", F.lit(1.0)), ["s_suppkey"])
    return c.table("supplier").select("s_suppkey", "s_acctbal")


@R.add("dml_truncate_flashback", "SELECT 0 AS now, (SELECT count(*) FROM supplier) AS before, (SELECT count(*) FROM supplier) AS restored")
def dml_truncate(spark: SparkSession, d: str) -> DataFrame:
    c = _catalog(spark, d)
    c.truncate("supplier")
    now = c.table("supplier").agg(F.count("*").cast("int").alias("now"))
    before = c.table("supplier", -2).agg(F.count("*").alias("before"))
    c.flashback("supplier", -2)
    return now.crossJoin(before).crossJoin(c.table("supplier").agg(F.count("*").alias("restored")))


@R.add("ddl_alter", "SELECT s_suppkey, s_name AS title, CAST(s_nationkey AS BIGINT) AS s_nationkey, 'x' AS note FROM supplier")
def ddl_alter(spark: SparkSession, d: str) -> DataFrame:
    c = _catalog(spark, d)
    c.alter("supplier", "add", "note", "string", "x")
    c.alter("supplier", "rename", "s_name", "title")
    c.alter("supplier", "type", "s_nationkey", "bigint")
    c.alter("supplier", "drop", "s_acctbal")
    return c.table("supplier")


@R.add("ddl_constraints", "SELECT true AS pk, true AS chk, true AS fk, 2 AS cascaded")
def ddl_constraints(spark: SparkSession, d: str) -> DataFrame:
    c = _catalog(spark, d)
    c.create_table("part_of", "id int, s_suppkey bigint", foreign_keys={"s_suppkey": ("supplier", "s_suppkey", "cascade")})
    c.insert("part_of", [{"id": i, "s_suppkey": i} for i in range(3)])

    def fails(f) -> bool:
        try:
            f()
        except ConstraintError:
            return True
        return False

    row = {"s_suppkey": 0, "s_name": "twice", "s_nationkey": 1}
    pk = fails(lambda: c.insert("supplier", [row]))
    chk = fails(lambda: c.insert("supplier", [row | {"s_suppkey": -5, "s_nationkey": -1}]))
    fk = fails(lambda: c.insert("part_of", [{"id": 9, "s_suppkey": 999999}]))
    c.delete("supplier", "s_suppkey = 1")
    return c.table("part_of").agg(F.count("*").cast("int").alias("cascaded")).select(F.lit(pk).alias("pk"), F.lit(chk).alias("chk"), F.lit(fk).alias("fk"), "cascaded")


@R.add("ddl_views_index_ctas", "SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey")
def ddl_views(spark: SparkSession, d: str) -> DataFrame:
    c = _catalog(spark, d)
    c.create_index("by_nation", "supplier", ["s_nationkey"])
    c.create_view("rich", "SELECT * FROM supplier WHERE s_acctbal > 0")
    c.create_table_as("summary", c.sql("SELECT s_nationkey, count(*) AS n FROM rich WHERE s_nationkey >= :low GROUP BY s_nationkey", low=0))
    return c.table("summary")


@R.add("ddl_backup_restore", "SELECT count(*) AS n FROM supplier")
def ddl_backup(spark: SparkSession, d: str) -> DataFrame:
    c = _catalog(spark, d)
    path = scratch(spark, "backup")
    names = c.backup(path)
    c.truncate("supplier")
    c.restore(path, names)
    return c.table("supplier").agg(F.count("*").alias("n"))


@R.add("procedures_triggers", "SELECT count(*) AS n, count(*) FILTER (WHERE s_nationkey = 7) AS logged FROM supplier WHERE s_nationkey <> 7 OR true")
def procedures(spark: SparkSession, d: str) -> DataFrame:
    c = _catalog(spark, d)
    c.create_table("log", "s_suppkey bigint")
    c.create_trigger("supplier", "after", "update", lambda rows: c.insert("log", rows.select("s_suppkey")))
    c.create_procedure("raise_nation", lambda cat, nation, by: cat.update("supplier", {"s_acctbal": F.col("s_acctbal") + by}, F.col("s_nationkey") == nation))
    c.call("raise_nation", 7, 5.0)
    return c.table("supplier").agg(F.count("*").alias("n")).crossJoin(c.table("log").agg(F.count("*").alias("logged")))


@R.add("sql_scripting", "SELECT 55 AS total")
def scripting(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("BEGIN DECLARE total INT DEFAULT 0; DECLARE i INT DEFAULT 1; WHILE i <= 10 DO SET total = total + i; SET i = i + 1; END WHILE; SELECT total AS total; END")


@R.add("view_incremental", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS o_totalprice FROM orders WHERE NOT (o_orderkey % 5 = 1 AND o_orderkey % 7 = 0) GROUP BY o_orderstatus")
def view_incremental(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    v = AggregateView(spark, scratch(spark, "view"), ["o_orderstatus", "o_orderpriority"], ["o_totalprice"])
    v.refresh(o.where("o_orderkey % 5 <> 0"))
    v.apply(added=o.where("o_orderkey % 5 = 0"), removed=o.where("o_orderkey % 5 = 1 AND o_orderkey % 7 = 0"))
    return v.answer(["o_orderstatus"], ["o_totalprice"]).withColumn("o_totalprice", F.round("o_totalprice", 2))


@R.add("result_cache", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def result_cache(spark: SparkSession, d: str) -> DataFrame:
    views(spark, d, "orders")
    cache = ResultCache(entries=2)
    cache.get(spark, "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus", ["orders"]).count()
    return cache.get(spark, "select o_orderstatus, count(*) as n from orders group by o_orderstatus;", ["orders"])


@R.add("query_builder", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE (o_totalprice BETWEEN 1000 AND 300000) AND (c_mktsegment LIKE 'B%' OR NOT c_nationkey IN (1, 2)) GROUP BY c_mktsegment HAVING count(*) > 10")
def query_builder(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    q = Query(table(spark, d, "customer")).join(o, "c_custkey", hint="USE_HASH")
    q.where({"and": [{"field": "o_totalprice", "op": "Between", "value": (1000, 300000)}, {"or": [{"field": "c_mktsegment", "op": "StartsWith", "value": "B"}, {"not": {"field": "c_nationkey", "op": "In", "value": [1, 2]}}]}]})
    out = q.group("c_mktsegment", n=("Count", "*"), total=("Sum", "o_totalprice")).having({"field": "n", "op": "Gt", "value": 10}).order("-n").run()
    return out.withColumn("total", F.round("total", 2))


@R.add("query_builder_page", "SELECT o_orderdate, o_orderkey FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1997-01-01', 50) ORDER BY 1, 2 LIMIT 15")
def query_builder_page(spark: SparkSession, d: str) -> DataFrame:
    at = pd.Timestamp("1997-01-01").to_pydatetime()
    from pyspark.sql.types import TimestampNTZType

    return Query(table(spark, d, "orders")).after({"o_orderdate": F.lit(at).cast(TimestampNTZType()), "o_orderkey": 50}).select("o_orderdate", "o_orderkey").order("o_orderdate", "o_orderkey").page(15).run()


@R.add("plan_report", "SELECT true AS hashed, true AS scanned")
def report(spark: SparkSession, d: str) -> DataFrame:
    found = plan_report(table(spark, d, "orders").groupBy("o_orderstatus").count())
    return spark.range(1).select(F.lit(any("HashAggregate" in k for k in found)).alias("hashed"), F.lit(any("Scan" in k for k in found)).alias("scanned"))


@R.add("partition_routing", "SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 THEN 2 WHEN o_totalprice >= 50000 THEN 1 ELSE 0 END AS r, CASE WHEN o_orderstatus IN ('F') THEN 'done' WHEN o_orderstatus IN ('O', 'P') THEN 'live' ELSE 'other' END AS l, CAST(date_trunc('month', o_orderdate) AS DATE) AS t FROM orders")
def partition_routing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", P.range_partition("o_totalprice", [50000, 200000]).alias("r"), P.list_partition("o_orderstatus", {"done": ["F"], "live": ["O", "P"]}).alias("l"), P.time_partition("o_orderdate", "month").alias("t"))


@R.add("partition_write_prune", "SELECT count(*) AS n FROM orders WHERE year(o_orderdate) = 1996")
def partition_write(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "parts")
    P.write_partitioned(table(spark, d, "orders"), path, y=F.year("o_orderdate"))
    return spark.read.parquet(path).where("y = 1996").agg(F.count("*").alias("n"))


@R.add("partition_sorted_bloom", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 77")
def partition_sorted(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "sorted")
    P.sorted_layout(table(spark, d, "orders"), ["o_custkey"], path, bloom=["o_custkey"])
    return spark.read.parquet(path).where("o_custkey = 77").select("o_orderkey", "o_totalprice")


def _round_trip(kind: str, **options) -> None:
    @R.add(f"source_{kind}", "SELECT n_nationkey, n_name FROM nation")
    def run(spark: SparkSession, d: str) -> DataFrame:
        path, t = scratch(spark, kind), table(spark, d, "nation").select("n_nationkey", "n_name")
        N.write(t, kind, path, **options)
        return N.read(spark, kind, path, t.schema, **options)


for _k in ("parquet", "orc", "json", "jsonl"):
    _round_trip(_k)
_round_trip("csv", header="true")


@R.add("source_python", "SELECT range AS id, range * range AS square FROM range(5, 50)")
def source_python(spark: SparkSession, d: str) -> DataFrame:
    spark.dataSource.register(N.SequenceSource)
    return spark.read.format("skein_sequence").options(start="5", end="50", partitions="3").load()


@R.add("etl_steps", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice * 2), 2) AS twice FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def etl_steps(spark: SparkSession, d: str) -> DataFrame:
    return N.etl(table(spark, d, "orders"), [("filter", "o_orderstatus = 'F'"), ("map", {"t": "o_totalprice * 2"}), ("aggregate", ["o_custkey"], {"n": "count(*)", "twice": "round(sum(t), 2)"}), ("select", ["o_custkey", "n", "twice"])])


@R.add("outbox_dead_letters", "SELECT count(*) FILTER (WHERE value > 10) AS good, count(*) FILTER (WHERE NOT value > 10) AS bad FROM events WHERE event_id >= 100")
def outbox(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    good, bad = N.with_dead_letters(N.outbox(e, e.where("event_id < 100"), "event_id"), F.col("value") > 10)
    return good.agg(F.count("*").alias("good")).crossJoin(bad.agg(F.count("*").alias("bad")))


@R.add("udf_vectorised", "SELECT o_orderstatus, count(*) AS n, round(sqrt(sum(o_totalprice * o_totalprice) / count(*)), 4) AS rms FROM orders GROUP BY o_orderstatus")
def udf_vectorised(spark: SparkSession, d: str) -> DataFrame:
    """A user aggregate as accumulate and finish over Spark's own partial sums, finished by a user function."""
    @F.pandas_udf("double")
    def root(x: pd.Series) -> pd.Series:
        return x**0.5

    parts = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.avg(F.col("o_totalprice") * F.col("o_totalprice")).alias("m"))
    return parts.select("o_orderstatus", "n", F.round(root("m"), 4).alias("rms"))


@R.add("udtf", "SELECT n_nationkey, unnest(generate_series(1, 3)) AS step FROM nation")
def udtf_query(spark: SparkSession, d: str) -> DataFrame:
    @F.udtf(returnType="step int")
    class Steps:
        def eval(self, n: int):
            for i in range(1, n + 1):
                yield (i,)

    spark.udtf.register("skein_steps", Steps)
    views(spark, d, "nation")
    return spark.sql("SELECT n_nationkey, step FROM nation, LATERAL skein_steps(3)")


# --- learning -------------------------------------------------------------------------------------


def _features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", (F.col("l_extendedprice") > 40000).cast("double").alias("dear"))


@R.add("ml_linear_regression", "SELECT true AS good")
def ml_linear(spark: SparkSession, d: str) -> DataFrame:
    x = _features(spark, d).withColumn("y", 3.0 * F.col("l_quantity") - 100.0 * F.col("l_discount") + 7)
    m = L.create_model(x, "linear_regression", ["l_quantity", "l_discount"], "y")
    return L.predict(m, x).agg((F.max(F.abs(F.col("prediction") - F.col("y"))) < 0.01).alias("good"))


def _classifier(name: str, **params) -> None:
    @R.add(f"ml_{name}", "SELECT true AS good")
    def run(spark: SparkSession, d: str) -> DataFrame:
        train, test = L.split(_features(spark, d), ["l_orderkey", "l_linenumber"])
        scale = "minmax" if name == "naive_bayes" else "standard"
        m = L.create_model(train, name, ["l_quantity", "l_extendedprice"], "dear", scale=scale, **params)
        return L.predict(m, test).agg((F.avg((F.col("prediction") == F.col("dear")).cast("int")) > 0.75).alias("good"))


_classifier("logistic_regression")
_classifier("naive_bayes", modelType="gaussian")
_classifier("decision_tree")
_classifier("random_forest", numTrees=10, seed=1)
_classifier("neural_network", layers=[2, 6, 2], seed=1, maxIter=60)


@R.add("ml_naive_bayes_rows", """WITH c AS (SELECT CASE WHEN l_extendedprice > 40000 THEN 1 ELSE 0 END AS k, l_quantity AS q, l_tax AS t FROM lineitem), e AS (SELECT 1e-9 * greatest(var_pop(q), var_pop(t)) AS eps FROM c),
m AS (SELECT k, ln((count(*) + 1.0) / ((SELECT count(*) FROM c) + 2.0)) AS prior, avg(q) AS mq, avg(t) AS mt, var_pop(q) + max(eps) AS vq, var_pop(t) + max(eps) AS vt FROM c, e GROUP BY k),
s AS (SELECT l_quantity, l_tax, k, prior - 0.5 * (ln(vq) + ln(vt) + power(l_quantity - mq, 2) / vq + power(l_tax - mt, 2) / vt) AS score FROM (SELECT DISTINCT l_quantity, l_tax FROM lineitem), m) SELECT l_quantity, l_tax, CAST(max_by(k, score) AS DOUBLE) AS prediction FROM s GROUP BY l_quantity, l_tax""")
def ml_naive_bayes_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every row's prediction by the densities of both classes, for each pair of values that occurs."""
    x = table(spark, d, "lineitem").select("l_quantity", "l_tax", (F.col("l_extendedprice") > 40000).cast("double").alias("dear"))
    m = L.create_model(x, "naive_bayes", ["l_quantity", "l_tax"], "dear", scale=None, modelType="gaussian")
    return L.predict(m, x).select("l_quantity", "l_tax", "prediction").distinct()


@R.add("ml_kmeans", "SELECT 3 AS clusters")
def ml_kmeans(spark: SparkSession, d: str) -> DataFrame:
    x = _features(spark, d)
    return L.predict(L.create_model(x, "kmeans", ["l_quantity", "l_extendedprice"], k=3, seed=1), x).agg(F.countDistinct("prediction").cast("int").alias("clusters"))


@R.add("ml_registry_split", "SELECT true AS same, true AS apart")
def ml_registry(spark: SparkSession, d: str) -> DataFrame:
    x = _features(spark, d)
    train, test = L.split(x, ["l_orderkey", "l_linenumber"])
    m = L.create_model(train, "linear_regression", ["l_quantity"], "l_extendedprice")
    r = L.ModelRegistry(spark, scratch(spark, "models"))
    r.register("price", m, note="first")
    a, b = L.predict(m, test), L.predict(r.load("price"), test)
    keys = ["l_orderkey", "l_linenumber", "l_quantity", "prediction"]
    same = a.select(keys).exceptAll(b.select(keys)).agg((F.count("*") == 0).alias("same"))
    both = train.join(test, ["l_orderkey", "l_linenumber"]).agg((F.count("*") == 0).alias("apart"))
    return same.crossJoin(both)

"""Rights and scripts, JSON schemas and places, star schemas, samples, models in SQL, features and series forecasts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinql.functions.scalars import SCALAR_FUNCTIONS as M
from skeinql.operators import documents as D
from skeinql.operators import learning as L
from skeinql.operators import spatial
from skeinql.operators.approximate import SampleCatalog
from skeinql.operators.joins import bloom_join
from skeinql.operators.olap import StarSchema
from skeinql.plans.catalog import Catalog, ConstraintError
from skeinql.plans.memory import ColumnStore, FragmentCache
from skeinql.plans.materialized import RefreshPolicy, ViewStore
from skeinql.plans.procedures import Cursor, Package, forall
from skeinql.queries._base import Registry, table
from skeinql.session import scratch

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _geography(spark: SparkSession, d: str, **actions: str) -> Catalog:
    """Regions, nations and suppliers with foreign keys."""
    c = Catalog(spark, scratch(spark, "catalog"))
    c.create_table("region", "id int", primary_key=["id"])
    c.create_table("nation", "id int, region int", primary_key=["id"], foreign_keys={"region": ("region", "id", actions.get("nation", "cascade"), "cascade")})
    c.create_table("supplier", "id bigint, nation int", primary_key=["id"], foreign_keys={"nation": ("nation", "id", actions.get("supplier", "cascade"), "cascade")})
    c.insert("region", table(spark, d, "region").select(F.col("r_regionkey").alias("id")))
    c.insert("nation", table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region")))
    c.insert("supplier", table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")))
    return c


@R.add("constraint_cascade", "SELECT s_suppkey AS id, n_nationkey + CASE WHEN n_nationkey = 7 THEN 100 ELSE 0 END AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 2")
def constraint_cascade(spark: SparkSession, d: str) -> DataFrame:
    """A region goes with its nations and their suppliers; a nation's key changes and suppliers follow."""
    c = _geography(spark, d)
    c.delete("region", "id = 2")
    c.update("nation", {"id": F.col("id") + 100}, "id = 7")
    return c.table("supplier").select("id", "nation")


@R.add("constraint_set_null", "SELECT s_suppkey AS id, CASE WHEN n_regionkey <> 2 THEN n_nationkey END AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def constraint_set_null(spark: SparkSession, d: str) -> DataFrame:
    c = _geography(spark, d, supplier="set null")
    c.delete("region", "id = 2")
    return c.table("supplier").select("id", "nation")


@R.add("constraint_restrict", "SELECT (SELECT count(*) FROM region) AS regions, (SELECT count(*) FROM nation) AS nations, (SELECT count(*) FROM supplier) AS suppliers")
def constraint_restrict(spark: SparkSession, d: str) -> DataFrame:
    """A delete that suppliers forbid leaves all tables as they were."""
    c = _geography(spark, d, supplier="restrict")
    try:
        c.delete("region", "true")
    except ConstraintError:
        pass
    n = lambda t, name: c.table(t).agg(F.count("*").alias(name))
    return n("region", "regions").crossJoin(n("nation", "nations")).crossJoin(n("supplier", "suppliers"))


@R.add("grants_obeyed", "SELECT n_nationkey AS id, n_regionkey AS region, 'view' AS seen_by FROM nation WHERE n_regionkey = 1")
def grants(spark: SparkSession, d: str) -> DataFrame:
    c = _geography(spark, d)
    c.create_view("america", "SELECT * FROM nation WHERE region = 1")
    c.grant("reader", "select", "america")
    who = c.as_role("reader")
    try:
        who.sql("SELECT * FROM nation").count()
        seen = "table"
    except PermissionError:
        seen = "view"
    return who.sql("SELECT * FROM america").withColumn("seen_by", F.lit(seen))


@R.add("ddl_databases", "SELECT n_nationkey AS id FROM nation WHERE n_regionkey = 3")
def databases(spark: SparkSession, d: str) -> DataFrame:
    c = _geography(spark, d)
    db = c.create_database("europe")
    db.create_table_as("nation", c.table("nation").where("region = 3").select("id"))
    c.create_database("empty")
    c.drop_database("empty")
    assert c.databases() == ["europe"]
    return c.database("europe").table("nation")


@R.add("ddl_drops", "SELECT 1 AS tables_left, 0 AS views_left, 0 AS indexes_left, 2 AS twice FROM range(1)")
def drops(spark: SparkSession, d: str) -> DataFrame:
    """A unique index goes with its constraint, so a key may come twice afterwards."""
    c = Catalog(spark, scratch(spark, "catalog"))
    c.create_table("t", "id int")
    c.create_table("gone", "id int")
    c.create_index("unique_id", "t", ["id"], unique=True)
    c.create_view("v", "SELECT * FROM t")
    c.insert("t", [{"id": 1}])
    c.drop_index("unique_id")
    c.drop_view("v")
    c.drop_table("gone")
    c.insert("t", [{"id": 1}])
    return c.table("t").agg(F.count("*").cast("int").alias("twice")).select(F.lit(len(c.tables())).alias("tables_left"), F.lit(len(c.views)).alias("views_left"), F.lit(len(c.indexes)).alias("indexes_left"), "twice")


@R.add("triggers_row_instead", "SELECT CAST(n_nationkey AS INT) AS id, CASE WHEN n_nationkey > 20 THEN -1 ELSE n_regionkey END AS region FROM nation")
def row_triggers(spark: SparkSession, d: str) -> DataFrame:
    c = Catalog(spark, scratch(spark, "catalog"))
    c.create_table("t", "id int, region int")
    c.create_row_trigger("t", "insert", {"region": "-1"}, "id > 20")
    c.create_trigger("t", "instead of", "delete", lambda rows: None)
    c.insert("t", table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region")))
    c.delete("t", "true")
    return c.table("t")


#: Fetched rows that one statement changes.
STATEMENT_ROWS = 10_000


@R.add("cursor_bulk_forall", "SELECT CAST(s_suppkey AS BIGINT) AS id, CASE WHEN s_nationkey = 5 THEN 6 ELSE s_nationkey END AS nation FROM supplier WHERE s_nationkey <> 4")
def cursors(spark: SparkSession, d: str) -> DataFrame:
    """A package's procedure fetches keys in bulk and changes and deletes their rows in one statement each."""
    c = _geography(spark, d)

    def move(own: Package, source: int, target: int) -> int:
        cursor, n, held = Cursor(lambda: c.table("supplier").where(F.col("nation") == source).select("id").orderBy("id")).open(), 0, []
        # a statement writes the table anew, so it takes many fetches
        while (rows := cursor.fetch_bulk(50)) or held:
            held += rows
            if not rows or len(held) >= STATEMENT_ROWS:
                n += forall(c, "supplier", "update", spark.createDataFrame([(r.id, target) for r in held], "id bigint, nation int"), ["id"])
                held = []
        cursor.close()
        return n

    p = Package(c, "suppliers")
    p.procedure("move", move)
    c.call("suppliers.move", 5, 6)
    forall(c, "supplier", "delete", c.table("supplier").where("nation = 4").select("id"), ["id"])
    return c.table("supplier")


@R.add("script_for_case", "SELECT sum(CASE WHEN n_regionkey = 0 THEN 1 WHEN n_regionkey = 1 THEN 10 ELSE 100 END) AS total FROM nation")
def script_for(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "nation").createOrReplaceTempView("nation")
    return spark.sql("BEGIN DECLARE total BIGINT DEFAULT 0; FOR r AS SELECT n_regionkey AS k FROM nation DO CASE r.k WHEN 0 THEN SET total = total + 1; WHEN 1 THEN SET total = total + 10; ELSE SET total = total + 100; END CASE; END FOR; SELECT total AS total; END")


@R.add("script_loop_handler", "SELECT 21 AS total, 'handled' AS state")
def script_handler(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("""BEGIN DECLARE total INT DEFAULT 0; DECLARE i INT DEFAULT 0; DECLARE state STRING DEFAULT 'none';
    l: LOOP SET i = i + 1; IF i > 10 THEN LEAVE l; END IF; IF i % 2 = 0 THEN ITERATE l; END IF; SET total = total + i; END LOOP;
    REPEAT SET total = total - 1; UNTIL total <= 21 END REPEAT;
    BEGIN DECLARE EXIT HANDLER FOR DIVIDE_BY_ZERO BEGIN SET state = 'handled'; END; SET i = 1 / 0; SET state = 'not reached'; END;
    SELECT total AS total, state AS state; END""")


@R.add("view_rewrite", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean, 'by_status' AS answered_by FROM orders GROUP BY o_orderstatus")
def view_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """The smallest view that holds the answer is used, kept up to date by a merged delta."""
    o = table(spark, d, "orders")
    now = [o.where("o_orderkey % 4 <> 0")]
    store = ViewStore(spark, scratch(spark, "views"))
    store.base("orders", lambda: now[0])
    store.create("by_status_priority", "orders", ["o_orderstatus", "o_orderpriority"], ["o_totalprice"], RefreshPolicy("commit"))
    store.create("by_status", "orders", ["o_orderstatus"], ["o_totalprice"], RefreshPolicy("commit"))
    now[0] = o
    store.changed("orders", added=o.where("o_orderkey % 4 = 0"))
    got, name = store.ask("orders", ["o_orderstatus"], {"n": ("count", ""), "total": ("sum", "o_totalprice"), "mean": ("avg", "o_totalprice")})
    return got.select("o_orderstatus", "n", F.round("total", 2).alias("total"), F.round("mean", 6).alias("mean"), F.lit(name).alias("answered_by"))


_SCHEMA = {
    "type": "object",
    "required": ["id", "balance"],
    "properties": {"id": {"type": "integer", "minimum": 10}, "balance": {"type": "number", "minimum": 0}, "segment": {"enum": ["BUILDING", "MACHINERY", "HOUSEHOLD", "FURNITURE"]}, "name": {"type": "string", "pattern": "[0-8]$"}},
    "additionalProperties": False,
}


@R.add("json_schema", "SELECT c_custkey, CASE WHEN c_custkey < 10 THEN 1 ELSE 0 END + CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END + CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1 ELSE 0 END + CASE WHEN c_name LIKE '%9' THEN 1 ELSE 0 END + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS errors FROM customer")
def json_schema(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    doc = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 7 == 0, F.lit(1)).alias("extra")))
    return c.select("c_custkey", F.size(D.json_schema_errors(doc, _SCHEMA)).alias("errors"))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    spot = F.array((F.col("c_custkey") * 37 % 90).cast("double"), (F.col("c_custkey") * 61 % 60).cast("double"))
    return c.select("c_custkey", F.to_json(F.struct(F.struct(F.lit("Point").alias("type"), spot.alias("coordinates")).alias("at"))).alias("doc"))


@R.add("document_geo", "WITH p AS (SELECT c_custkey, CAST(c_custkey * 37 % 90 AS DOUBLE) AS x, CAST(c_custkey * 61 % 60 AS DOUBLE) AS y FROM customer) SELECT c_custkey, 2 * 6371008.8 * asin(sqrt(least(1, power(sin(radians(48 - y) / 2), 2) + cos(radians(y)) * cos(radians(48)) * power(sin(radians(11 - x) / 2), 2)))) <= 2000000 AS near, x BETWEEN 10 AND 40 AND y BETWEEN 5 AND 20 AS boxed, y <= x AND x <= 50 AND y >= 0 AS meets FROM p")
def document_geo(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc")
    triangle = {"type": "Polygon", "coordinates": [[[0.0, 0.0], [50.0, 0.0], [50.0, 50.0], [0.0, 0.0]]]}
    return _placed(spark, d).select("c_custkey", D.geo_near(doc, "$.at", 11.0, 48.0, 2_000_000.0).alias("near"), D.geo_within_box(doc, "$.at", (10.0, 5.0), (40.0, 20.0)).alias("boxed"), D.geo_relates(doc, "$.at", triangle).alias("meets"))


@R.add("olap_star", "SELECT c_mktsegment AS customer_c_mktsegment, p_brand AS part_p_brand, sum(l_quantity) AS qty, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey WHERE p_size > 25 GROUP BY 1, 2")
def olap_star(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    star = StarSchema(table(spark, d, "lineitem").join(o, "l_orderkey"))
    star.dimension("customer", table(spark, d, "customer"), "o_custkey", "c_custkey").dimension("part", table(spark, d, "part"), "l_partkey", "p_partkey").dimension("supplier", table(spark, d, "supplier"), "l_suppkey", "s_suppkey")
    return star.query(["customer.c_mktsegment", "part.p_brand"], "part.p_size > 25", qty=F.sum("l_quantity"), n=F.count("*"))


@R.add("to_char_formats", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS day, format('{:,.2f}', o_totalprice) AS price FROM orders")
def to_char(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", M["TO_CHAR"](F.col("o_orderdate"), "yyyy/MM/dd").alias("day"), F.trim(M["TO_CHAR"](F.col("o_totalprice").cast("decimal(12,2)"), "999,999,999.99")).alias("price"))


@R.add("current_time", "SELECT true AS same_day, true AS recent")
def current_time(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select((M["CURRENT_DATE"]() == M["CURRENT_TIMESTAMP"]().cast("date")).alias("same_day"), (M["SYSDATE"]() > F.lit("2020-01-01").cast("timestamp")).alias("recent"))


@R.add("sample_routing", "SELECT true AS inside, true AS sampled, true AS whole_when_exact")
def sample_routing(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    c = SampleCatalog()
    c.register("lineitem", l)
    for f in (0.2, 0.5):
        c.add_sample("lineitem", f, ["l_orderkey", "l_linenumber"], scratch(spark, "sample"))
    got, fraction = c.mean("lineitem", "l_quantity", 0.1)
    _, exact = c.mean("lineitem", "l_quantity", 1e-9)
    whole = l.agg(F.avg("l_quantity").alias("m"))
    return got.crossJoin(whole).select(((F.col("m") >= F.col("low") - 1) & (F.col("m") <= F.col("high") + 1)).alias("inside"), F.lit(fraction < 1).alias("sampled"), F.lit(exact == 1.0).alias("whole_when_exact"))


# --- learning: what least squares and moments give ------------------------------------------------
@R.add("ml_sql_regression", "SELECT l_orderkey, l_linenumber, round(s * l_quantity + i, 3) AS prediction FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem)")
def ml_sql(spark: SparkSession, d: str) -> DataFrame:
    """CREATE MODEL, RETRAIN and PREDICT as statements; predictions are those of the regression line."""
    table(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    r = L.ModelRegistry(spark, scratch(spark, "models"))
    r.execute("CREATE MODEL price USING linear_regression FEATURES (l_quantity) TARGET l_extendedprice AS SELECT l_quantity, l_extendedprice FROM lineitem WHERE l_linenumber = 1")
    r.execute("RETRAIN MODEL price AS SELECT l_quantity, l_extendedprice FROM lineitem")
    again = L.ModelRegistry(spark, r.root)
    out = again.execute("PREDICT price AS SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
    return out.select("l_orderkey", "l_linenumber", F.round("prediction", 3).alias("prediction"))


@R.add("ml_feature_scores", "SELECT 'l_quantity' AS feature, round(var_samp(l_quantity), 6) AS variance, round(abs(corr(l_quantity, l_extendedprice)), 9) AS correlation FROM lineitem UNION ALL SELECT 'l_tax', round(var_samp(l_tax), 6), round(abs(corr(l_tax, l_extendedprice)), 9) FROM lineitem UNION ALL SELECT 'l_discount', round(var_samp(l_discount), 6), round(abs(corr(l_discount, l_extendedprice)), 9) FROM lineitem")
def ml_features(spark: SparkSession, d: str) -> DataFrame:
    x = L.feature_scores(table(spark, d, "lineitem"), ["l_quantity", "l_tax", "l_discount"], "l_extendedprice")
    return x.select("feature", F.round("variance", 6).alias("variance"), F.round("correlation", 9).alias("correlation"))


@R.add("ml_explain_linear", "WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, avg(l_quantity) AS m FROM lineitem) SELECT l_orderkey, l_linenumber, round(s * (l_quantity - m), 3) AS part FROM lineitem, s")
def ml_explain(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    out = L.contributions(l, L.explain_linear(l, ["l_quantity"], "l_extendedprice"), ["l_quantity"])
    return out.select("l_orderkey", "l_linenumber", F.round("l_quantity_contribution", 3).alias("part"))


@R.add("ml_interval", "WITH c AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem), r AS (SELECT l_quantity, s * l_quantity + i AS p, l_extendedprice - s * l_quantity - i AS e FROM lineitem, c) SELECT l_quantity, round(min(p) - 1.96 * (SELECT stddev_samp(e) FROM r), 2) AS low, round(min(p) + 1.96 * (SELECT stddev_samp(e) FROM r), 2) AS high FROM r GROUP BY l_quantity")
def ml_interval(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    p = L.predict(L.create_model(l, "linear_regression", ["l_quantity"], "l_extendedprice", scale=None), l)
    out = L.with_interval(p, p, "l_extendedprice")
    return out.groupBy("l_quantity").agg(F.round(F.min("low"), 2).alias("low"), F.round(F.min("high"), 2).alias("high"))


@R.add("ml_binning_encoding", "SELECT l_returnflag, CAST(least(4, floor((l_quantity - (SELECT min(l_quantity) FROM lineitem)) / ((SELECT max(l_quantity) - min(l_quantity) FROM lineitem) / 5.0))) AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2")
def ml_binning(spark: SparkSession, d: str) -> DataFrame:
    out = L.binned(table(spark, d, "lineitem").select("l_returnflag", "l_quantity"), "l_quantity", 5)
    return out.groupBy("l_returnflag", F.col("l_quantity_bin").cast("int").alias("bin")).agg(F.count("*").alias("n"))


@R.add("user_aggregate", "SELECT o_orderstatus, round(exp(avg(ln(o_totalprice))), 4) AS geometric_mean FROM orders GROUP BY o_orderstatus")
def user_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """A user's aggregate with initial state, accumulate, merge and finish: states are made by partition and merged by group."""
    from skeinql.functions.aggregates import UserAggregate, aggregate

    mean = UserAggregate("n long, s double", lambda: (0, 0.0), lambda state, x: (state[0] + len(x), state[1] + float(x.map(math.log).sum())), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: math.exp(s[1] / s[0]), "double")
    out = aggregate(table(spark, d, "orders"), ["o_orderstatus"], "o_totalprice", mean, "geometric_mean")
    return out.withColumn("geometric_mean", F.round("geometric_mean", 4))


# --- memory, joins by Bloom filters, routes and features ------------------------------------------
@R.add("column_store", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, true AS in_memory, false AS other_in_memory FROM orders WHERE o_totalprice > 50000 GROUP BY o_orderstatus")
def column_store(spark: SparkSession, d: str) -> DataFrame:
    """Two columns are populated, filtered and aggregated in memory; what wasn't populated comes from files."""
    store = ColumnStore(1 << 40)
    store.register("orders", table(spark, d, "orders"))
    store.want("orders", ["o_orderstatus", "o_totalprice"], priority=5)
    store.populate()
    rows, here = store.scan("orders", ["o_orderstatus", "o_totalprice"], "o_totalprice > 50000")
    _, other = store.scan("orders", ["o_custkey"])
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).withColumns({"in_memory": F.lit(here), "other_in_memory": F.lit(other)})


@R.add("fragment_cache", "WITH f AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT (SELECT count(*) FROM f WHERE t > 100000) AS large, (SELECT count(*) FROM f WHERE t <= 100000) AS small, 1 AS hits")
def fragment_cache(spark: SparkSession, d: str) -> DataFrame:
    cache = FragmentCache()
    part = lambda: table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"))
    a, b = cache.shared(part()), cache.shared(part())
    return a.where("t > 100000").agg(F.count("*").alias("large")).crossJoin(b.where("t <= 100000").agg(F.count("*").alias("small"))).withColumn("hits", F.lit(cache.hits))


@R.add("join_bloom", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 7")
def join_bloom(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return bloom_join(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), p, "l_partkey").select("l_orderkey", "l_linenumber", "p_name")


@R.add("geo_service_area", "SELECT CAST(n_nationkey + 100 AS BIGINT) AS id, CAST(1 + n_nationkey AS DOUBLE) AS distance FROM nation WHERE n_regionkey = 1 AND 1 + n_nationkey <= 15 UNION ALL SELECT CAST(s_suppkey + 1000 AS BIGINT), 2.0 + n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 AND 2 + n_nationkey <= 15 UNION ALL SELECT CAST(1 AS BIGINT), 0.0")
def service_area(spark: SparkSession, d: str) -> DataFrame:
    """What lies within a cost of 15 of a region, over its nations (1 and their number) and suppliers (1 more)."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey") + 100).cast("long").alias("dst"), (1.0 + F.col("n_nationkey")).alias("w"))
    s = table(spark, d, "supplier").select((F.col("s_nationkey") + 100).cast("long").alias("src"), (F.col("s_suppkey") + 1000).alias("dst"), F.lit(1.0).alias("w"))
    return spatial.service_area(n.union(s), 1, 15.0, "w")


@R.add("geo_formats", "SELECT n_nationkey, 'LINESTRING (' || n_nationkey || ' 0, 1 ' || n_regionkey || ')' AS wkt, 41 AS bytes, '{\"type\": \"LineString\", \"coordinates\": [[' || n_nationkey || ', 0], [1, ' || n_regionkey || ']]}' AS geojson, round(sqrt(power(n_nationkey - 1.0, 2) + power(n_regionkey, 2)), 9) AS length FROM nation")
def formats(spark: SparkSession, d: str) -> DataFrame:
    """WKT to WKB and GeoJSON."""
    g = F.concat(F.lit("LINESTRING ("), F.col("n_nationkey"), F.lit(" 0, 1 "), F.col("n_regionkey"), F.lit(")"))
    return table(spark, d, "nation").select("n_nationkey", g.alias("wkt"), F.octet_length(spatial.st_wkb(g)).alias("bytes"), spatial.st_geojson(g).alias("geojson"), F.round(spatial.st_length(g), 9).alias("length"))


@R.add("pipeline_replace_root", "SELECT c_nationkey AS nation, c_mktsegment AS segment FROM customer WHERE c_acctbal > 0")
def replace_root(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_acctbal", F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("home"))
    return D.aggregate(c, [{"$match": {"c_acctbal": {"$gt": 0}}}, {"$replaceRoot": {"newRoot": "$home"}}])


@R.add("ml_impute_index", "WITH x AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS price FROM orders), r AS (SELECT o_orderpriority, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS i FROM orders GROUP BY 1) SELECT o_orderkey, round(coalesce(price, (SELECT avg(price) FROM x)), 4) AS filled, CAST(i AS DOUBLE) AS code FROM x JOIN r USING (o_orderpriority)")
def impute_index(spark: SparkSession, d: str) -> DataFrame:
    """A column's nulls become its mean, and a category its place by frequency."""
    from pyspark.ml import Pipeline

    x = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("price"))
    out = Pipeline(stages=L.preprocessing(["price"], ["o_orderpriority"], scale=None, impute="mean")).fit(x).transform(x)
    return out.select("o_orderkey", F.round("price_filled", 4).alias("filled"), F.col("o_orderpriority_index").alias("code"))


@R.add("ml_polynomial", "SELECT l_orderkey, l_linenumber, round(l_quantity + l_quantity * l_quantity + l_tax + l_tax * l_tax + l_quantity * l_tax, 6) AS total FROM lineitem")
def polynomial(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    out = Pipeline(stages=L.preprocessing(["l_quantity", "l_tax"], scale=None, degree=2)).fit(x).transform(x)
    return out.select("l_orderkey", "l_linenumber", F.round(F.aggregate(vector_to_array("features"), F.lit(0.0), lambda s, v: s + v), 6).alias("total"))

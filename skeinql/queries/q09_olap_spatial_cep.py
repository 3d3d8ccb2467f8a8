"""OLAP cubes, geometry and event patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinql.operators import cep, spatial as G
from skeinql.operators.olap import Cube
from skeinql.queries._base import Registry, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _cube(spark: SparkSession, d: str) -> Cube:
    facts = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q"), F.month("l_shipdate").alias("m"))
    return Cube(facts, ["l_returnflag", "l_linestatus"], {"qty": F.sum("l_quantity"), "n": F.count("*")}, {"time": ["y", "q", "m"]})


_T = "f AS (SELECT l_returnflag, l_linestatus, l_quantity, CAST(year(l_shipdate) AS INT) AS y, CAST(quarter(l_shipdate) AS INT) AS q, CAST(month(l_shipdate) AS INT) AS m FROM lineitem)"


@R.add("olap_cube", f"WITH {_T} SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS grouping_id, sum(l_quantity) AS qty, count(*) AS n FROM f GROUP BY CUBE (l_returnflag, l_linestatus)")
def olap_cube(spark: SparkSession, d: str) -> DataFrame:
    return _cube(spark, d).cube()


@R.add("olap_rollup", f"WITH {_T} SELECT y, q, grouping_id(y, q) AS grouping_id, sum(l_quantity) AS qty, count(*) AS n FROM f GROUP BY ROLLUP (y, q)")
def olap_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _cube(spark, d).rollup("y", "q")


@R.add("olap_grouping_sets", f"WITH {_T} SELECT l_returnflag, y, sum(l_quantity) AS qty, count(*) AS n FROM f GROUP BY GROUPING SETS ((l_returnflag), (y), ())")
def olap_sets(spark: SparkSession, d: str) -> DataFrame:
    return _cube(spark, d).grouping_sets(["l_returnflag"], ["y"], [])


@R.add("olap_slice", f"WITH {_T} SELECT l_linestatus, sum(l_quantity) AS qty, count(*) AS n FROM f WHERE l_returnflag = 'R' GROUP BY l_linestatus")
def olap_slice(spark: SparkSession, d: str) -> DataFrame:
    return _cube(spark, d).slice("l_returnflag", "R").by("l_linestatus")


@R.add("olap_dice", f"WITH {_T} SELECT y, sum(l_quantity) AS qty, count(*) AS n FROM f WHERE l_returnflag IN ('R', 'A') AND l_linestatus = 'F' GROUP BY y")
def olap_dice(spark: SparkSession, d: str) -> DataFrame:
    return _cube(spark, d).dice(l_returnflag=["R", "A"], l_linestatus="F").by("y")


@R.add("olap_drill_down", f"WITH {_T} SELECT y, q, m, sum(l_quantity) AS qty, count(*) AS n FROM f GROUP BY y, q, m")
def olap_drill(spark: SparkSession, d: str) -> DataFrame:
    return _cube(spark, d).drill_down("time", "q")


@R.add("olap_roll_up", f"WITH {_T} SELECT y, sum(l_quantity) AS qty, count(*) AS n FROM f GROUP BY y")
def olap_up(spark: SparkSession, d: str) -> DataFrame:
    return _cube(spark, d).roll_up("time", "q")


@R.add("olap_pivot", f"WITH {_T} SELECT y, sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS \"A\", sum(l_quantity) FILTER (WHERE l_returnflag = 'N') AS \"N\", sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS \"R\" FROM f GROUP BY y")
def olap_pivot(spark: SparkSession, d: str) -> DataFrame:
    return _cube(spark, d).pivot(["y"], "l_returnflag", "qty", ["A", "N", "R"])


R.sql("sql_unpivot", "lineitem", "SELECT l_orderkey, l_linenumber, k, v FROM (SELECT l_orderkey, l_linenumber, l_discount AS disc, l_tax AS tax FROM lineitem) UNPIVOT (v FOR k IN (disc, tax))", "SELECT l_orderkey, l_linenumber, k, v FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_discount AS disc, l_tax AS tax FROM lineitem) ON disc, tax INTO NAME k VALUE v)")


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Customers on a plane, placed by their columns."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 101).cast("double").alias("x"), (F.col("c_custkey") * 61 % 89).cast("double").alias("y"), F.col("c_acctbal").alias("v"))


_P = "p AS (SELECT c_custkey AS id, CAST(c_custkey * 37 % 101 AS DOUBLE) AS x, CAST(c_custkey * 61 % 89 AS DOUBLE) AS y, c_acctbal AS v FROM customer)"


@R.add("geo_sphere", f"WITH {_P}, q AS (SELECT id, x / 2 AS lat, y * 2 - 90 AS lon FROM p) SELECT id, round(2 * 6371008.8 * asin(sqrt(power(sin(radians(48 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48)) * power(sin(radians(11 - lon) / 2), 2))), 3) AS metres, round(6378137.0 * radians(lon), 3) AS mx, CAST(floor((lon + 180) / 6) + 1 AS INT) AS zone FROM q")
def geo_sphere(spark: SparkSession, d: str) -> DataFrame:
    q = _points(spark, d).select("id", (F.col("x") / 2).alias("lat"), (F.col("y") * 2 - 90).alias("lon"))
    la, lo = F.col("lat"), F.col("lon")
    return q.select("id", F.round(G.haversine(la, lo, F.lit(48.0), F.lit(11.0)), 3).alias("metres"), F.round(G.web_mercator(la, lo)[0], 3).alias("mx"), G.utm_zone(lo).alias("zone"))


@R.add("geo_near_pairs", f"WITH {_P} SELECT a.id AS a, b.id AS b, round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 6) AS distance FROM p a JOIN p b ON power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 4 AND a.id < b.id")
def geo_near(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return G.near_pairs(p, p, 2.0).where("a < b").withColumn("distance", F.round("distance", 6))


@R.add("geo_nearest", f"WITH {_P}, r AS (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY power(a.x - b.x, 2) + power(a.y - b.y, 2), b.id) AS n FROM p a JOIN p b ON power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 25) SELECT a, b FROM r WHERE n <= 3")
def geo_nearest(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return G.nearest(p, p, 3, 5.0).select("a", "b")


@R.add("geo_morans_i", f"WITH {_P}, s AS (SELECT avg(v) AS m, var_pop(v) AS s2 FROM p), w AS (SELECT a.v AS va, b.v AS vb FROM p a JOIN p b ON a.id <> b.id AND power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 9) SELECT round(sum((va - m) * (vb - m)) / count(*) / max(s2), 8) AS i FROM w, s")
def geo_moran(spark: SparkSession, d: str) -> DataFrame:
    return G.morans_i(_points(spark, d), "v", 3.0).select(F.round("i", 8).alias("i"))


@R.add("geo_hot_spots", f"WITH {_P}, s AS (SELECT avg(v) AS m, stddev_pop(v) AS sd, count(*) AS n FROM p), w AS (SELECT a.id, sum(b.v) AS t, count(*) AS k FROM p a JOIN p b ON power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 9 GROUP BY a.id) SELECT id, round((t - m * k) / (sd * sqrt((n * k - k * k) / (n - 1))), 6) AS z FROM w, s")
def geo_hot(spark: SparkSession, d: str) -> DataFrame:
    return G.hot_spots(_points(spark, d), "v", 3.0).withColumn("z", F.round("z", 6))


@R.add("geo_extent", f"WITH {_P} SELECT min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM p")
def geo_extent(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).agg(G.extent("x", "y").alias("e")).select("e.*")


@R.add("geo_in_polygon", f"WITH {_P} SELECT id FROM p WHERE x > 10.5 AND x < 40.5 AND y > 5.5 AND y < 30.5")
def geo_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    box = F.lit("POLYGON ((10.5 5.5, 40.5 5.5, 40.5 30.5, 10.5 30.5, 10.5 5.5))")
    p = _points(spark, d).withColumn("wkt", F.concat(F.lit("POINT ("), F.col("x"), F.lit(" "), F.col("y"), F.lit(")")))
    return p.where(G.st_contains(box, F.col("wkt"))).select("id")


@R.add("geo_measures", "SELECT 12::DOUBLE AS area, 14::DOUBLE AS perimeter, 5::DOUBLE AS distance, true AS meets, 4::DOUBLE AS common, 'POINT (2 1.5)' AS center")
def geo_measures(spark: SparkSession, d: str) -> DataFrame:
    one = spark.createDataFrame([("POLYGON ((0 0, 4 0, 4 3, 0 3, 0 0))", "POINT (7 7)", "POLYGON ((2 1, 9 1, 9 9, 2 9, 2 1))")], "a string, b string, c string")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return one.select(G.st_area(a).alias("area"), G.st_length(a).alias("perimeter"), G.st_distance(a, b).alias("distance"), G.st_intersects(a, c).alias("meets"), G.st_area(G.st_intersection(a, c)).alias("common"), G.st_centroid(a).alias("center"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of 25 boxes, among them equal, nested, touching and distant ones."""
    n = table(spark, d, "nation").select((F.col("n_nationkey") % 6).cast("double").alias("x"), (F.col("n_nationkey") % 4).cast("double").alias("y"), (1 + F.col("n_nationkey") % 3).cast("double").alias("w"), F.col("n_nationkey").alias("id"))
    ring = lambda x, y: F.concat(x.cast("string"), F.lit(" "), y.cast("string"))
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    wkt = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", ring(x + w, y), ring(x + w, y + w), ring(x, y + w), ring(x, y), ring(x + w, y)), F.lit("))"))
    g = n.select("id", wkt.alias("wkt"))
    return g.select(F.col("id").alias("a"), F.col("wkt").alias("ga")).crossJoin(g.select(F.col("id").alias("b"), F.col("wkt").alias("gb")))


_B = """b AS (SELECT n_nationkey AS id, CAST(n_nationkey % 6 AS DOUBLE) AS x1, CAST(n_nationkey % 4 AS DOUBLE) AS y1, n_nationkey % 6 + 1.0 + n_nationkey % 3 AS x2, n_nationkey % 4 + 1.0 + n_nationkey % 3 AS y2 FROM nation),
p AS (SELECT a.id AS a, b.id AS b, (a.x2 - a.x1) * (a.y2 - a.y1) AS sa, (b.x2 - b.x1) * (b.y2 - b.y1) AS sb, least(a.x2, b.x2) - greatest(a.x1, b.x1) AS w, least(a.y2, b.y2) - greatest(a.y1, b.y1) AS h,
 a.x1 <= b.x1 AND a.x2 >= b.x2 AND a.y1 <= b.y1 AND a.y2 >= b.y2 AS ab, b.x1 <= a.x1 AND b.x2 >= a.x2 AND b.y1 <= a.y1 AND b.y2 >= a.y2 AS ba FROM b a, b b)"""


@R.add("geo_predicates", f"WITH {_B} SELECT a, b, w >= 0 AND h >= 0 AS intersects, ab AS contains, ab AND ba AS equals, w >= 0 AND h >= 0 AND NOT (w > 0 AND h > 0) AS touches, w > 0 AND h > 0 AND NOT ab AND NOT ba AS overlaps, round(sqrt(power(greatest(0.0, -w), 2) + power(greatest(0.0, -h), 2)), 9) AS distance FROM p")
def geo_predicates(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("ga"), F.col("gb")
    return _boxes(spark, d).select("a", "b", G.st_intersects(a, b).alias("intersects"), G.st_contains(a, b).alias("contains"), G.st_equals(a, b).alias("equals"), G.st_touches(a, b).alias("touches"), G.st_overlaps(a, b).alias("overlaps"), F.round(G.st_distance(a, b), 9).alias("distance"))


@R.add("geo_overlay", f"WITH {_B}, i AS (SELECT a, b, sa, sb, greatest(0.0, w) * greatest(0.0, h) AS c FROM p) SELECT a, b, round(c, 6) AS common, round(sa + sb - c, 6) AS either, round(sa - c, 6) AS only_a, round(sa + sb - 2 * c, 6) AS one_of FROM i")
def geo_overlay(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("ga"), F.col("gb")
    size = lambda g, n: F.round(G.st_area(g), 6).alias(n)
    return _boxes(spark, d).select("a", "b", size(G.st_intersection(a, b), "common"), size(G.st_union(a, b), "either"), size(G.st_difference(a, b), "only_a"), size(G.st_symdifference(a, b), "one_of"))


@R.add("geo_buffer_simplify", "SELECT n_nationkey, round(32 * sin(2 * pi() / 64) * power(1 + n_nationkey % 3, 2) + 20.0 * (1 + n_nationkey % 3), 6) AS area, 2 AS points FROM nation")
def geo_buffer(spark: SparkSession, d: str) -> DataFrame:
    """A straight line of length 10 with a point that hardly leaves it, simplified and then widened: two half discs of 64 segments a turn and a box."""
    line = table(spark, d, "nation").select("n_nationkey", F.lit("LINESTRING (0 0, 4 0.001, 10 0)").alias("g"))
    out = None
    for r in (1, 2, 3):
        part = line.where(F.col("n_nationkey") % 3 == r - 1).withColumn("s", G.st_simplify(F.col("g"), 0.01))
        part = part.select("n_nationkey", F.round(G.st_area(G.st_buffer(F.col("s"), float(r), 64)), 6).alias("area"), (F.size(F.split("s", ",")).cast("int")).alias("points"))
        out = part if out is None else out.unionByName(part)
    return out


@R.add("geo_voronoi", "SELECT n_regionkey, count(*) AS cells, round(3600.0, 4) AS area FROM nation GROUP BY n_regionkey")
def geo_voronoi(spark: SparkSession, d: str) -> DataFrame:
    """The cells of each region's points fill the window."""
    n = table(spark, d, "nation").select("n_regionkey", F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey") * 37 % 59 + 0.5).alias("x"), (F.col("n_nationkey") * 23 % 53 + 0.5).alias("y"))
    return G.voronoi(n, "n_regionkey", (0.0, 0.0, 60.0, 60.0)).groupBy("n_regionkey").agg(F.count("*").alias("cells"), F.round(F.sum(G.st_area(F.col("wkt"))), 4).alias("area"))


@R.add("geo_delaunay", """WITH q AS (SELECT n_regionkey, CAST(n_nationkey AS BIGINT) AS id, n_nationkey * 37 % 59 + 0.5 AS x, n_nationkey * 23 % 53 + 0.5 AS y FROM nation),
t AS (SELECT a.n_regionkey, a.id AS a, b.id AS b, c.id AS c, a.x AS ax, a.y AS ay, b.x - a.x AS bx, b.y - a.y AS by_, c.x - a.x AS cx, c.y - a.y AS cy FROM q a JOIN q b ON b.n_regionkey = a.n_regionkey AND a.id < b.id JOIN q c ON c.n_regionkey = a.n_regionkey AND b.id < c.id),
o AS (SELECT *, (cy * (bx * bx + by_ * by_) - by_ * (cx * cx + cy * cy)) / (2 * (bx * cy - by_ * cx)) AS ux, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by_ * by_)) / (2 * (bx * cy - by_ * cx)) AS uy FROM t WHERE bx * cy <> by_ * cx)
SELECT n_regionkey, a, b, c FROM o WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.n_regionkey = o.n_regionkey AND q.id NOT IN (a, b, c) AND power(q.x - ax - ux, 2) + power(q.y - ay - uy, 2) < (ux * ux + uy * uy) * (1 - 1e-9))""")
def geo_delaunay(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_regionkey", F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey") * 37 % 59 + 0.5).alias("x"), (F.col("n_nationkey") * 23 % 53 + 0.5).alias("y"))
    return G.delaunay(n, "n_regionkey")


@R.add("geo_utm", f"WITH {_P} SELECT id, round(x / 2 - 25, 8) AS lat, round(y * 2 - 90, 8) AS lon, CAST(floor((y * 2 + 90) / 6) + 1 AS INT) AS zone FROM p")
def geo_utm(spark: SparkSession, d: str) -> DataFrame:
    """To UTM and back."""
    q = _points(spark, d).select("id", (F.col("x") / 2 - 25).alias("lat"), (F.col("y") * 2 - 90).alias("lon"))
    zone, east, north = G.utm(F.col("lat"), F.col("lon"))
    t = q.select("id", zone.alias("zone"), east.alias("e"), north.alias("n"), (F.col("lat") < 0).alias("south"))
    lat, lon = G.utm_inverse(F.col("zone"), F.col("e"), F.col("n"), F.col("south"))
    return t.select("id", F.round(lat, 8).alias("lat"), F.round(lon, 8).alias("lon"), "zone")


@R.add("geo_window", f"WITH {_P} SELECT id FROM p WHERE x BETWEEN 20 AND 45 AND y BETWEEN 10 AND 30")
def geo_window(spark: SparkSession, d: str) -> DataFrame:
    tree = G.packed(_points(spark, d), 50)
    return G.window_search(tree, G.leaves(tree), (20.0, 10.0, 45.0, 30.0)).select("id")


@R.add("geo_quadtree", f"""WITH {_P}, c AS (SELECT id, least(15, greatest(0, CAST(floor(x / 128 * 16) AS BIGINT))) AS cx, least(15, greatest(0, CAST(floor(y / 128 * 16) AS BIGINT))) AS cy FROM p),
k AS (SELECT id, array_to_string(list_transform([3, 2, 1, 0], lambda i: CAST(((cx >> i) & 1) + 2 * ((cy >> i) & 1) AS VARCHAR)), '') AS key FROM c),
n AS (SELECT left(key, s) AS node, count(*) AS n FROM k, (SELECT unnest([0, 1, 2, 3, 4]) AS s) GROUP BY 1)
SELECT id, coalesce((SELECT min_by(n.node, length(n.node)) FROM n WHERE n.n <= 40 AND starts_with(k.key, n.node)), key) AS leaf FROM k""")
def geo_quadtree(spark: SparkSession, d: str) -> DataFrame:
    return G.quadtree(_points(spark, d), (0.0, 0.0, 128.0, 128.0), 40, 4).select("id", "leaf")


@R.add("raster_regions", """WITH RECURSIVE g AS (SELECT n_nationkey // 5 AS x, n_nationkey % 5 AS y, n_regionkey % 2 AS value, n_nationkey AS id FROM nation),
e AS (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.value = b.value AND abs(a.x - b.x) + abs(a.y - b.y) = 1), r(id, seen) AS (SELECT id, id FROM g UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen),
m AS (SELECT id, min(seen) AS root FROM r GROUP BY id) SELECT g.value, CAST(min(m.root) // 5 AS VARCHAR) || ',' || CAST(min(m.root) % 5 AS VARCHAR) AS region, count(*) AS cells, CAST(count(*) AS DOUBLE) AS area FROM m JOIN g USING (id) GROUP BY m.root, g.value""")
def raster_regions(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "nation").select(F.floor(F.col("n_nationkey") / 5).cast("long").alias("x"), (F.col("n_nationkey") % 5).cast("long").alias("y"), (F.col("n_regionkey") % 2).alias("value"))
    return G.regions(g).select("value", "region", "cells", G.st_area(F.col("wkt")).alias("area"))


@R.add("raster_contours", """WITH g AS (SELECT n_nationkey // 5 AS x, n_nationkey % 5 AS y, CAST(n_nationkey AS DOUBLE) AS v FROM nation) SELECT l AS level, CAST(count(*) AS BIGINT) AS segments FROM g a JOIN g b ON b.x = a.x + 1 AND b.y = a.y JOIN g c ON c.x = a.x + 1 AND c.y = a.y + 1 JOIN g d ON d.x = a.x AND d.y = a.y + 1, (SELECT unnest([7.5, 11.5, 16.5]) AS l) WHERE greatest(a.v, b.v, c.v, d.v) >= l AND least(a.v, b.v, c.v, d.v) < l GROUP BY l""")
def raster_contours(spark: SparkSession, d: str) -> DataFrame:
    """On a slope each cell that a level passes through has one segment."""
    g = table(spark, d, "nation").select(F.floor(F.col("n_nationkey") / 5).cast("int").alias("x"), (F.col("n_nationkey") % 5).alias("y"), F.col("n_nationkey").cast("double").alias("value"))
    return G.contours(g, [7.5, 11.5, 16.5]).groupBy("level").agg(F.count("*").alias("segments"))


@R.add("geo_kmeans")
def geo_kmeans(spark: SparkSession, d: str) -> DataFrame:
    """Held against Lloyd's rounds in plain Python in the tests: the first centres are chosen by a hash that SQL hasn't."""
    return G.kmeans(_points(spark, d), 4, 10)


@R.add("geo_dbscan", f"WITH RECURSIVE {_P}, w AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 2.25), k AS MATERIALIZED (SELECT a AS id FROM w GROUP BY a HAVING count(*) >= 3), e AS MATERIALIZED (SELECT a, b FROM w SEMI JOIN k ON w.a = k.id WHERE b IN (SELECT id FROM k)), r(id, seen) AS (SELECT id, id FROM k UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen), c AS MATERIALIZED (SELECT id, min(seen) AS cluster FROM r GROUP BY id), o AS (SELECT w.a AS id, min(c.cluster) AS cluster FROM w JOIN c ON c.id = w.b WHERE w.a NOT IN (SELECT id FROM k) GROUP BY w.a) SELECT p.id, coalesce(c.cluster, o.cluster) AS cluster FROM p LEFT JOIN c ON c.id = p.id LEFT JOIN o ON o.id = p.id")
def geo_dbscan(spark: SparkSession, d: str) -> DataFrame:
    return G.dbscan(_points(spark, d), 1.5, 3)


@R.add("geo_hilbert", f"WITH RECURSIVE {_P}, h(id, s, x, y, place) AS (SELECT id, 64, CAST(x AS BIGINT), CAST(y AS BIGINT), CAST(0 AS BIGINT) FROM p UNION ALL SELECT id, s // 2, CASE WHEN ry = 0 THEN (CASE WHEN rx = 1 THEN s - 1 - b ELSE b END) ELSE a END, CASE WHEN ry = 0 THEN (CASE WHEN rx = 1 THEN s - 1 - a ELSE a END) ELSE b END, place + s * s * xor(3 * rx, ry) FROM (SELECT id, s, place, x & (s - 1) AS a, y & (s - 1) AS b, CASE WHEN x & s > 0 THEN 1 ELSE 0 END AS rx, CASE WHEN y & s > 0 THEN 1 ELSE 0 END AS ry FROM h WHERE s > 0)) SELECT id, CAST(place AS BIGINT) AS place FROM h WHERE s = 0")
def geo_hilbert(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).select("id", G.hilbert(F.col("x").cast("long"), F.col("y").cast("long"), 7).alias("place"))


@R.add("raster_focal", "WITH g AS (SELECT n_nationkey // 5 AS x, n_nationkey % 5 AS y, CAST(n_nationkey AS DOUBLE) AS value FROM nation) SELECT a.x, a.y, round(avg(b.value), 6) AS value FROM g a JOIN g b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.x, a.y")
def raster_focal(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "nation").select(F.floor(F.col("n_nationkey") / 5).cast("int").alias("x"), (F.col("n_nationkey") % 5).alias("y"), F.col("n_nationkey").cast("double").alias("value"))
    return G.focal_mean(g).withColumn("value", F.round("value", 6))


# --- patterns -------------------------------------------------------------------------------------
_is = lambda t: F.col("event_type") == t


@R.add("cep_sequence", "WITH e AS (SELECT event_id, user_id, ts, event_type, max(CASE WHEN event_type = 'view' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM events) SELECT event_id FROM e WHERE event_type = 'purchase' AND f IS NOT NULL AND ts <= f + INTERVAL 6 HOUR")
def cep_sequence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    first = F.max(F.when(_is("view"), F.col("ts"))).over(w)
    return e.withColumn("f", first).where(_is("purchase") & F.col("f").isNotNull() & (F.col("ts") <= F.col("f") + F.expr("INTERVAL 6 HOURS"))).select("event_id")


@R.add("cep_absence", "WITH e AS (SELECT event_id, ts, event_type, min(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS l FROM events) SELECT event_id FROM e WHERE event_type = 'click' AND (l IS NULL OR l > ts + INTERVAL 1 DAY)")
def cep_absence(spark: SparkSession, d: str) -> DataFrame:
    return cep.absent_after(table(spark, d, "events"), ["user_id"], "ts", _is("click"), _is("purchase"), "1 DAY").select("event_id")


@R.add("cep_within", """WITH e AS (SELECT user_id, ts, event_type, value, lead(event_type) OVER w AS t2, lead(ts) OVER w AS ts2, lead(value) OVER w AS v2, lead(event_type, 2) OVER w AS t3, lead(ts, 2) OVER w AS ts3, lead(value, 2) OVER w AS v3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, ts AS start, CASE WHEN t3 = 'click' AND ts3 <= ts + INTERVAL 12 HOUR THEN ts3 ELSE ts2 END AS "end", CASE WHEN t3 = 'click' AND ts3 <= ts + INTERVAL 12 HOUR THEN 3 ELSE 2 END AS events, round(value + v2 + CASE WHEN t3 = 'click' AND ts3 <= ts + INTERVAL 12 HOUR THEN v3 ELSE 0 END, 6) AS total FROM e WHERE event_type = 'view' AND t2 = 'click' AND ts2 <= ts + INTERVAL 12 HOUR""")
def cep_within(spark: SparkSession, d: str) -> DataFrame:
    """A greedy step takes what the time limit leaves: a view and one or two clicks within 12 hours."""
    steps = [cep.Step("v", _is("view")), cep.Step("c", _is("click"), (1, 2))]
    return cep.match(table(spark, d, "events"), ["user_id"], "ts", steps, within_seconds=43200, skip="to_next", value="value", tie=["event_id"]).select("user_id", "start", "end", "events", F.round("total", 6).alias("total"))


@R.add("cep_pattern")
def cep_pattern(spark: SparkSession, d: str) -> DataFrame:
    steps = [cep.Step("v", _is("view")), cep.Step("c", _is("click"), "+"), cep.Step("p", _is("purchase"))]
    return cep.match(table(spark, d, "events"), ["user_id"], "ts", steps, within_seconds=86400 * 3, value="value", tie=["event_id"])


@R.add("cep_followed_by")
def cep_followed(spark: SparkSession, d: str) -> DataFrame:
    return cep.match(table(spark, d, "events"), ["user_id"], "ts", cep.followed_by(cep.Step("s", _is("signup")), cep.Step("p", _is("purchase"))), within_seconds=86400.0, tie=["event_id"])


@R.add("event_correlation", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'click' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 7200000000")
def correlation(spark: SparkSession, d: str) -> DataFrame:
    from skeinql.operators.joins import interval_join

    e = table(spark, d, "events")
    a, b = (e.where(_is(t)).select(F.col("event_id").alias(n), "user_id", F.col("ts").alias(f"t{n}")) for n, t in (("a", "error"), ("b", "click")))
    return interval_join(a, b, ["user_id"], "ta", "tb", 7200).select("a", "b")

"""Geometry over WKT text and coordinate columns.

Distances on the sphere, projections, grid cells and raster algebra are column arithmetic. Predicates and
constructions on whole geometries parse WKT in vectorised functions. Neighbour joins go by grid cells, so
points far apart never meet.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
from collections.abc import Callable, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinql.operators import planar

EARTH = 6371008.8
#: The WGS 84 ellipsoid (metres) and the radius of Web Mercator.
WGS84_A, WGS84_F, MERCATOR = 6378137.0, 1 / 298.257223563, 6378137.0

_rad = F.radians


# --- columns --------------------------------------------------------------------------------------


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on the sphere."""
    a = F.pow(F.sin(_rad(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(_rad(lat1)) * F.cos(_rad(lat2)) * F.pow(F.sin(_rad(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees from north, 0 to 360."""
    y = F.sin(_rad(lon2 - lon1)) * F.cos(_rad(lat2))
    x = F.cos(_rad(lat1)) * F.sin(_rad(lat2)) - F.sin(_rad(lat1)) * F.cos(_rad(lat2)) * F.cos(_rad(lon2 - lon1))
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def destination(lat: Column, lon: Column, direction: Column, metres: Column) -> tuple[Column, Column]:
    d, b = metres / EARTH, _rad(direction)
    la = F.asin(F.sin(_rad(lat)) * F.cos(d) + F.cos(_rad(lat)) * F.sin(d) * F.cos(b))
    lo = _rad(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(_rad(lat)), F.cos(d) - F.sin(_rad(lat)) * F.sin(la))
    return F.degrees(la), F.pmod(F.degrees(lo) + 540, F.lit(360.0)) - 180


def web_mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    return F.lit(MERCATOR) * _rad(lon), F.lit(MERCATOR) * F.log(F.tan(F.lit(math.pi / 4) + _rad(lat) / 2))


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def bbox_intersects(a: Column, b: Column) -> Column:
    """Of structs (xmin, ymin, xmax, ymax)."""
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def bbox_contains(a: Column, b: Column) -> Column:
    return (a["xmin"] <= b["xmin"]) & (a["xmax"] >= b["xmax"]) & (a["ymin"] <= b["ymin"]) & (a["ymax"] >= b["ymax"])


def cell(x: Column, y: Column, size: float) -> Column:
    """A grid cell as a struct of two numbers."""
    return F.struct(F.floor(x / size).cast("long").alias("cx"), F.floor(y / size).cast("long").alias("cy"))


def hilbert(x: Column, y: Column, order: int) -> Column:
    """Place on the Hilbert curve of a cell (x, y) of a 2^order grid."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(acc: Column, s: Column) -> Column:
        low = s - 1
        rx, ry = (acc["x"].bitwiseAND(s) > 0).cast("long"), (acc["y"].bitwiseAND(s) > 0).cast("long")
        a, b = acc["x"].bitwiseAND(low), acc["y"].bitwiseAND(low)
        fa, fb = F.when(rx == 1, low - a).otherwise(a), F.when(rx == 1, low - b).otherwise(b)
        place = acc["d"] + s * s * (3 * rx).bitwiseXOR(ry)
        return F.struct(F.when(ry == 0, fb).otherwise(a).alias("x"), F.when(ry == 0, fa).otherwise(b).alias("y"), place.alias("d"))

    sizes = F.array(*[F.lit(1 << k).cast("long") for k in range(order - 1, -1, -1)])
    return F.aggregate(sizes, start, step, lambda acc: acc["d"])


#: Ids of one place that go through the grid in one row.
CHUNK = 4096

_PLACED = "x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)"


def _near(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Places (x, y, what) at most radius apart, as (ax, ay, a, b, distance), by grid cells; a and b are what they carry."""
    a = a.where(_PLACED).select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("what").alias("a"), F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = b.where(_PLACED).select(F.col("x").alias("bx"), F.col("y").alias("by"), F.col("what").alias("b"), F.explode(steps).alias("s"))
    b = b.select("bx", "by", "b", (F.floor(F.col("bx") / radius) + F.col("s.i")).alias("cx"), (F.floor(F.col("by") / radius) + F.col("s.j")).alias("cy"))
    d = F.sqrt(F.pow(F.col("ax") - F.col("bx"), F.lit(2.0)) + F.pow(F.col("ay") - F.col("by"), F.lit(2.0)))
    # few rows may stand for much work, so they are dealt by cell and not by the size of a table
    return a.join(b.hint("merge"), ["cx", "cy"]).select("ax", "ay", "a", "b", d.alias("distance")).where(F.col("distance") <= radius)


def _ids(points: DataFrame) -> DataFrame:
    """(x, y, what): the ids of each place in an array, in several where a place has very many."""
    points = points.where(_PLACED).select("id", "x", "y")
    parts = points.groupBy("x", "y").agg(F.ceil(F.count("*") / F.lit(CHUNK)).alias("parts"))
    return points.join(parts, ["x", "y"]).groupBy("x", "y", F.pmod(F.xxhash64("id"), "parts").alias("part")).agg(F.collect_list("id").alias("what")).drop("part")


def near_pairs(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """(a, b, distance) of points (id, x, y) at most radius apart: places meet by grid cells, and their ids are paired last."""
    near = _near(_ids(points), _ids(others), radius)
    return near.select(F.explode("a").alias("a"), "b", "distance").select("a", F.explode("b").alias("b"), "distance")


def _nearest_within(points: DataFrame, others: DataFrame, k: int, radius: float) -> DataFrame:
    """(a, b, distance) of the k nearest others within the radius (of equally near ones the smaller id), found once for each place."""
    from pyspark.sql.window import Window

    # more than k of one place are never among the k nearest
    own = F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))
    first = others.where(_PLACED).select("id", "x", "y").withColumn("n", own).where(F.col("n") <= k).groupBy("x", "y").agg(F.collect_list("id").alias("what"))
    near = _near(points.select("x", "y", F.lit(None).alias("what")).distinct(), first, radius).select(F.col("ax").alias("x"), F.col("ay").alias("y"), F.explode("b").alias("b"), "distance")
    rank = F.row_number().over(Window.partitionBy("x", "y").orderBy("distance", "b"))
    found = near.withColumn("n", rank).where(F.col("n") <= k).groupBy("x", "y").agg(F.collect_list(F.struct("b", "distance")).alias("found"))
    return points.select(F.col("id").alias("a"), "x", "y").join(found, ["x", "y"]).select("a", F.inline("found"))


def nearest(points: DataFrame, others: DataFrame, k: int, radius: float | None = None) -> DataFrame:
    """(a, b, distance) of the k nearest others: of all, or within the radius if one is given.

    Without one, a search radius doubles for the points that have fewer others within it.
    """
    from skeinql.operators.graph import _cut

    if radius is not None:
        return _nearest_within(points, others, k, radius)
    points, others = points.where(_PLACED), others.where(_PLACED)
    enough = others.limit(k).count()
    box = points.select("x", "y").union(others.select("x", "y")).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    far = 0.0 if box[0] is None else ((box[1] - box[0]) ** 2 + (box[3] - box[2]) ** 2) ** 0.5
    radius = far * (k / max(others.count(), 1)) ** 0.5 or 1.0
    out, left = None, points
    while True:
        found = _cut(_nearest_within(left, others, k, radius))
        done = found.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= enough).select(F.col("a").alias("id"))
        left = _cut(left.join(done, "id", "left_anti"))
        last = radius > far or left.isEmpty()
        own = found if last else found.join(done.withColumnRenamed("id", "a"), "a", "left_semi")
        out = own if out is None else out.union(own)
        if last:
            return out
        radius *= 2


def dbscan(points: DataFrame, eps: float, least: int) -> DataFrame:
    """(id, cluster): the smallest core point reached; null for noise. A border point joins its smallest core neighbour's cluster.

    Points of one place have the same neighbours, so places are clustered, under the smallest id of each.
    """
    from skeinql.operators.graph import _cut, components

    places = points.groupBy("x", "y").agg(F.struct(F.min("id").alias("id"), F.count("*").alias("n")).alias("what"))
    near = _cut(_near(places, places, eps).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("b.n").alias("n")))
    core = near.groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select(F.col("a").alias("id"))
    links = near.join(core.withColumnRenamed("id", "a"), "a").join(core.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = components(core, links)
    border = near.join(core.withColumnRenamed("id", "a"), "a", "left_anti").join(found.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("component"))
    of = places.where(_PLACED).select("x", "y", F.col("what.id").alias("id")).join(found.union(border), "id").select("x", "y", F.col("component").alias("cluster"))
    return points.select("id", "x", "y").join(of, ["x", "y"], "left").select("id", "cluster")


def morans_i(points: DataFrame, value: str, radius: float) -> DataFrame:
    """(i) over points (id, x, y, value), neighbours within the radius. Sums of places are multiplied, and a point's pairs with itself taken off."""
    stats = points.agg(F.avg(value).alias("m"), F.var_pop(value).alias("_var"))
    z = points.crossJoin(F.broadcast(stats)).select("id", "x", "y", (F.col(value) - F.col("m")).alias("z"))
    places = z.groupBy("x", "y").agg(F.struct(F.coalesce(F.sum("z"), F.lit(0.0)).alias("z"), F.count("*").alias("n")).alias("what"))
    pairs = _near(places, places, radius).agg(F.sum(F.col("a.z") * F.col("b.z")).alias("s"), F.sum(F.col("a.n") * F.col("b.n")).alias("w"))
    far = F.pow(F.col("x") - F.col("bx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("by"), F.lit(2.0))
    same = z.join(z.select("id", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("zb")), "id").where(F.sqrt(far) <= radius)
    own = same.agg(F.coalesce(F.sum(F.col("z") * F.col("zb")), F.lit(0.0)).alias("s0"), F.count("*").alias("w0"))
    return pairs.crossJoin(own).crossJoin(stats).select(((F.col("s") - F.col("s0")) / F.nullif(F.col("w") - F.col("w0"), F.lit(0)) / F.nullif("_var", F.lit(0.0))).alias("i"))


def hot_spots(points: DataFrame, value: str, radius: float) -> DataFrame:
    """(id, z): Getis-Ord Gi* of each point, itself among its neighbours. Sums are taken by place."""
    stats = points.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.count("*").alias("n"))
    places = points.groupBy("x", "y").agg(F.struct(F.sum(value).alias("v"), F.count("*").alias("n")).alias("what"))
    near = _near(places, places, radius).groupBy(F.col("ax").alias("x"), F.col("ay").alias("y")).agg(F.sum("b.v").alias("t"), F.sum("b.n").alias("k"))
    w = points.select("id", "x", "y").join(near, ["x", "y"]).groupBy("id").agg(F.sum("t").alias("t"), F.sum("k").alias("k"))
    z = (F.col("t") - F.col("m") * F.col("k")) / (F.col("s") * F.sqrt((F.col("n") * F.col("k") - F.col("k") * F.col("k")) / (F.col("n") - 1)))
    return w.crossJoin(F.broadcast(stats)).select("id", z.alias("z"))


def extent(x: str, y: str) -> Column:
    return F.struct(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"))


def raster_algebra(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    """(x, y, value) of two bands' cells."""
    return a.select("x", "y", F.col("value").alias("va")).join(b.select("x", "y", F.col("value").alias("vb")), ["x", "y"]).select("x", "y", f(F.col("va"), F.col("vb")).alias("value"))


def ndvi(red: DataFrame, infrared: DataFrame) -> DataFrame:
    return raster_algebra(red, infrared, lambda r, n: (n - r) / F.nullif(n + r, F.lit(0.0)))


def focal_mean(band: DataFrame, reach: int = 1) -> DataFrame:
    """Mean of each cell and its neighbours."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)])
    spread = band.select(F.explode(steps).alias("s"), "x", "y", "value").select((F.col("x") + F.col("s.i")).alias("x"), (F.col("y") + F.col("s.j")).alias("y"), F.col("value").alias("v"))
    return band.select("x", "y").join(spread, ["x", "y"]).groupBy("x", "y").agg(F.avg("v").alias("value"))


# --- geometries -----------------------------------------------------------------------------------


@lru_cache(maxsize=4096)
def parse_wkt(text: str) -> tuple[str, list]:
    """(type, nested lists of coordinates), not to be changed; collections hold (type, coordinates) pairs. Texts are kept, as one side of a join is often one geometry."""
    m = re.fullmatch(r"\s*(?:SRID=\d+;)?\s*([A-Za-z]+)\s*(?:Z|M|ZM)?\s*(.*?)\s*", text, re.S)
    if not m:
        raise ValueError(f"not WKT: {text[:40]}")
    kind, body = m[1].upper(), m[2]
    if body.upper() == "EMPTY":
        return kind, []
    if kind in ("GEOMETRYCOLLECTION", "COMPOUNDCURVE"):
        inner, depth, start, out = body[1:-1], 0, 0, []
        for i, ch in enumerate(inner + ","):
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 0:
                part = inner[start:i].strip()
                out.append(parse_wkt(part if part[0].isalpha() else "LINESTRING " + part))
                start = i + 1
        return kind, out
    nested = re.sub(r"[^(),]+", lambda n: "[" + ",".join(n[0].split()) + "]" if n[0].strip() else "", body)
    import json

    data = json.loads(nested.replace("(", "[").replace(")", "]"))
    if kind == "POINT":
        return kind, data[0]
    if kind == "MULTIPOINT":
        return kind, [p[0] if isinstance(p[0], list) else p for p in data]
    return kind, data


def to_wkt(kind: str, data: list) -> str:
    if not data:
        return f"{kind} EMPTY"
    if kind in ("GEOMETRYCOLLECTION", "COMPOUNDCURVE"):
        return f"{kind} ({', '.join(to_wkt(*g) for g in data)})"
    num = lambda v: repr(int(v)) if float(v).is_integer() else repr(float(v))

    def text(x) -> str:
        return " ".join(map(num, x)) if not isinstance(x[0], list) else "(" + ", ".join(text(p) for p in x) + ")"

    return f"{kind} ({text(data)})" if kind == "POINT" else f"{kind} {text(data)}"


#: WKB type numbers.
WKB = {"POINT": 1, "LINESTRING": 2, "POLYGON": 3, "MULTIPOINT": 4, "MULTILINESTRING": 5, "MULTIPOLYGON": 6, "GEOMETRYCOLLECTION": 7}


def to_wkb(kind: str, data: list) -> bytes:
    head = struct.pack("<BI", 1, WKB[kind])
    points = lambda ps: struct.pack("<I", len(ps)) + b"".join(struct.pack("<dd", *p[:2]) for p in ps)
    if kind == "POINT":
        return head + struct.pack("<dd", *(data[:2] if data else (math.nan, math.nan)))
    if kind == "LINESTRING":
        return head + points(data)
    if kind == "POLYGON":
        return head + struct.pack("<I", len(data)) + b"".join(points(r) for r in data)
    parts = data if kind == "GEOMETRYCOLLECTION" else [(kind[5:], d) for d in data]
    return head + struct.pack("<I", len(parts)) + b"".join(to_wkb(*p) for p in parts)


def parse_wkb(raw: bytes) -> tuple[str, list]:
    at = 0

    def take(fmt: str):
        nonlocal at
        out = struct.unpack_from(order + fmt, raw, at)
        at += struct.calcsize(order + fmt)
        return out

    def one() -> tuple[str, list]:
        nonlocal order, at
        order = "<" if raw[at] else ">"
        at += 1
        kind = {v: k for k, v in WKB.items()}[take("I")[0] % 1000]
        if kind == "POINT":
            return kind, list(take("dd"))
        n = take("I")[0]
        if kind == "LINESTRING":
            return kind, [list(take("dd")) for _ in range(n)]
        if kind == "POLYGON":
            return kind, [[list(take("dd")) for _ in range(take("I")[0])] for _ in range(n)]
        parts = [one() for _ in range(n)]
        return kind, parts if kind == "GEOMETRYCOLLECTION" else [p[1] for p in parts]

    order = "<"
    return one()


def to_geojson(kind: str, data: list) -> str:
    import json

    names = {n.upper(): n for n in ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")}
    if kind == "GEOMETRYCOLLECTION":
        return json.dumps({"type": "GeometryCollection", "geometries": [json.loads(to_geojson(*g)) for g in data]})
    return json.dumps({"type": names[kind], "coordinates": data})


def _points(kind: str, data: list) -> list:
    shape = planar.parts(kind, data)
    return [*shape[0], *(p for line in shape[1] for p in line), *(p for poly in shape[2] for ring in poly for p in ring)]


def _segments(kind: str, data: list) -> list:
    return planar.Shape(kind, data).segments


def area(kind: str, data: list) -> float:
    one = lambda r: sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:])) / 2
    polygons = [data] if kind == "POLYGON" else data if kind == "MULTIPOLYGON" else []
    return sum(abs(one(p[0])) - sum(abs(one(h)) for h in p[1:]) for p in polygons if p)


def length(kind: str, data: list) -> float:
    return sum(math.hypot(b[0] - a[0], b[1] - a[1]) for a, b in _segments(kind, data))


def centroid(kind: str, data: list) -> tuple[str, list]:
    if kind == "POLYGON" and data and area(kind, data):
        r, a = data[0], 0.0
        cx = cy = 0.0
        for p, q in zip(r, r[1:]):
            c = p[0] * q[1] - q[0] * p[1]
            a, cx, cy = a + c, cx + (p[0] + q[0]) * c, cy + (p[1] + q[1]) * c
        return "POINT", [cx / (3 * a), cy / (3 * a)]
    ps = _points(kind, data)
    return "POINT", [sum(p[0] for p in ps) / len(ps), sum(p[1] for p in ps) / len(ps)]


def vincenty(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """Metres on the ellipsoid; nan where the iteration doesn't settle (near-antipodal points)."""
    b = WGS84_A * (1 - WGS84_F)
    u1, u2 = (math.atan((1 - WGS84_F) * math.tan(math.radians(x))) for x in (lat1, lat2))
    big = lam = math.radians(lon2 - lon1)
    for _ in range(200):
        sin_s = math.hypot(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        if sin_s == 0:
            return 0.0
        cos_s = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        sigma = math.atan2(sin_s, cos_s)
        sin_a = math.cos(u1) * math.cos(u2) * math.sin(lam) / sin_s
        cos2 = 1 - sin_a**2
        mid = cos_s - 2 * math.sin(u1) * math.sin(u2) / cos2 if cos2 else 0.0
        c = WGS84_F / 16 * cos2 * (4 + WGS84_F * (4 - 3 * cos2))
        old, lam = lam, big + (1 - c) * WGS84_F * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
        if abs(lam - old) < 1e-12:
            k = cos2 * (WGS84_A**2 - b**2) / b**2
            p = 1 + k / 16384 * (4096 + k * (k * (320 - 175 * k) - 768))
            q = k / 1024 * (256 + k * (k * (74 - 47 * k) - 128))
            delta = q * sin_s * (mid + q / 4 * (cos_s * (2 * mid**2 - 1) - q / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
            return b * p * (sigma - delta)
    return math.nan


def _pair(f: Callable, kind: str):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(parse_wkt(x), parse_wkt(y)) for x, y in zip(a, b)])

    return run


def _one(f: Callable, kind: str):
    @F.pandas_udf(kind)
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(*parse_wkt(x)) for x in a])

    return run


#: Functions of one or two WKT columns.
st_contains = lambda a, b: _pair(planar.contains, "boolean")(a, b)
st_covers = lambda a, b: _pair(planar.covers, "boolean")(a, b)
st_within = lambda a, b: st_contains(b, a)
st_intersects = lambda a, b: _pair(planar.intersects, "boolean")(a, b)
st_disjoint = lambda a, b: _pair(lambda x, y: not planar.intersects(x, y), "boolean")(a, b)
st_touches = lambda a, b: _pair(planar.touches, "boolean")(a, b)
st_overlaps = lambda a, b: _pair(planar.overlaps, "boolean")(a, b)
st_crosses = lambda a, b: _pair(planar.crosses, "boolean")(a, b)
st_equals = lambda a, b: _pair(planar.equals, "boolean")(a, b)
st_distance = lambda a, b: _pair(planar.distance, "double")(a, b)
st_area = lambda a: _one(area, "double")(a)
st_length = lambda a: _one(length, "double")(a)
st_centroid = lambda a: _one(lambda k, d: to_wkt(*centroid(k, d)), "string")(a)
st_buffer = lambda a, r, segments=32: _one(lambda k, d: to_wkt(*planar.buffer(k, d, r, segments)), "string")(a)
st_hull = lambda a: _one(lambda k, d: to_wkt("POLYGON", [planar.convex_hull(_points(k, d))]), "string")(a)
st_simplify = lambda a, t, method="douglas-peucker": _one(lambda k, d: to_wkt(*planar.simplify(k, d, t, method)), "string")(a)
st_geojson = lambda a: _one(to_geojson, "string")(a)
st_wkb = lambda a: _one(to_wkb, "binary")(a)
st_union = lambda a, b: _overlay("union")(a, b)
st_intersection = lambda a, b: _overlay("intersection")(a, b)
st_difference = lambda a, b: _overlay("difference")(a, b)
st_symdifference = lambda a, b: _overlay("symdifference")(a, b)


def _overlay(how: str) -> Callable:
    return _pair(lambda x, y: to_wkt(*planar.combined(how)(x, y)), "string")


def delaunay(points: DataFrame, key: str) -> DataFrame:
    """(key, a, b, c): the triangles of each key's points (id, x, y), which fit one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        rows = [(pdf[key][0], *sorted(pdf["id"][[a, b, c]])) for a, b, c in planar.delaunay(pdf[["x", "y"]].to_numpy().tolist())]
        return pd.DataFrame(rows, columns=[key, "a", "b", "c"])

    kind = points.schema[key].dataType.simpleString()
    return points.select(key, "id", "x", "y").groupBy(key).applyInPandas(run, f"{key} {kind}, a long, b long, c long")


def voronoi(points: DataFrame, key: str, window: tuple[float, float, float, float]) -> DataFrame:
    """(key, id, wkt): what is nearer to each point than to any other of its key, inside of a window; a key's points fit one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        cells = planar.voronoi(pdf[["x", "y"]].to_numpy().tolist(), window)
        return pd.DataFrame({key: pdf[key], "id": pdf["id"], "wkt": [to_wkt("POLYGON", [c] if c else []) for c in cells]})

    kind = points.schema[key].dataType.simpleString()
    return points.select(key, "id", "x", "y").groupBy(key).applyInPandas(run, f"{key} {kind}, id long, wkt string")


def utm(lat: Column, lon: Column, zone: Column | None = None) -> tuple[Column, Column, Column]:
    """(zone, easting, northing) in metres, north of the equator without a false northing, south of it with 10,000 km (Krueger's series)."""
    n, a, alpha, _, _ = _krueger()
    zone = utm_zone(lon) if zone is None else zone
    lam, phi = _rad(lon - (zone * 6 - 183)), _rad(lat)
    e = F.lit(2 * math.sqrt(n) / (1 + n))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = eta + sum((F.lit(alpha[j]) * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j in range(3)), F.lit(0.0))
    north = xi + sum((F.lit(alpha[j]) * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j in range(3)), F.lit(0.0))
    scale = F.lit(0.9996 * a)
    return zone, F.lit(500_000.0) + scale * east, F.when(lat < 0, F.lit(10_000_000.0)).otherwise(0.0) + scale * north


def utm_inverse(zone: Column, east: Column, north: Column, south: Column) -> tuple[Column, Column]:
    """(latitude, longitude) of UTM coordinates; south: whether the false northing is in them."""
    n, a, _, beta, delta = _krueger()
    scale = F.lit(0.9996 * a)
    xi, eta = (north - F.when(south, F.lit(10_000_000.0)).otherwise(0.0)) / scale, (east - 500_000.0) / scale
    x = xi - sum((F.lit(beta[j]) * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j in range(3)), F.lit(0.0))
    y = eta - sum((F.lit(beta[j]) * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j in range(3)), F.lit(0.0))
    chi = F.asin(F.sin(x) / F.cosh(y))
    phi = chi + sum((F.lit(delta[j]) * F.sin(2 * (j + 1) * chi) for j in range(3)), F.lit(0.0))
    return F.degrees(phi), zone * 6 - 183 + F.degrees(F.atan2(F.sinh(y), F.cos(x)))


def _krueger() -> tuple[float, float, list[float], list[float], list[float]]:
    """The third flattening, the rectifying radius, and the series forwards, back and to latitudes, to the third order."""
    n = WGS84_F / (2 - WGS84_F)
    a = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    return n, a, alpha, beta, delta


def kmeans(points: DataFrame, k: int, iterations: int = 20) -> DataFrame:
    """(id, cluster): Lloyd's rounds over (id, x, y) from k points chosen by a hash; only the k centres are on the driver."""
    first = points.where("x IS NOT NULL AND y IS NOT NULL").select("x", "y").distinct().orderBy(F.xxhash64("x", "y"), "x", "y").limit(k).collect()
    centres = [(r.x, r.y) for r in first]

    def nearest_of(cs: list) -> Column:
        d = F.array(*[F.struct((F.pow(F.col("x") - x, F.lit(2.0)) + F.pow(F.col("y") - y, F.lit(2.0))).alias("d"), F.lit(i).alias("i")) for i, (x, y) in enumerate(cs)])
        return F.array_min(d)["i"]

    for _ in range(iterations):
        means = {r.c: (r.x, r.y) for r in points.groupBy(nearest_of(centres).alias("c")).agg(F.avg("x").alias("x"), F.avg("y").alias("y")).collect()}
        new = [means.get(i, c) for i, c in enumerate(centres)]
        if new == centres:
            break
        centres = new
    return points.select("id", nearest_of(centres).alias("cluster"))


def regions(band: DataFrame) -> DataFrame:
    """(value, region, cells, wkt): cells (x, y, value) of equal value joined by their sides as polygons; region: its smallest cell as 'x,y'."""
    from skeinql.operators.graph import components

    cells = band.where("value IS NOT NULL").select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "value").withColumn("id", F.format_string("%020d,%020d", F.col("x") + F.lit(1 << 40), F.col("y") + F.lit(1 << 40)))
    side = [cells.select((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), "value", F.col("id").alias("other")) for dx, dy in ((1, 0), (0, 1))]
    edges = cells.join(side[0].union(side[1]), ["x", "y", "value"]).select(F.col("id").alias("src"), F.col("other").alias("dst"))
    of = components(cells.select("id"), edges)
    own = cells.join(of, "id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        have, spots, kept = set(zip(pdf["x"], pdf["y"])), {}, set()
        for x, y in have:
            for (ax, ay), (bx, by), out in (((0, 0), (1, 0), (0, -1)), ((1, 0), (1, 1), (1, 0)), ((1, 1), (0, 1), (0, 1)), ((0, 1), (0, 0), (-1, 0))):
                if (x + out[0], y + out[1]) not in have:
                    p, q = (x + ax, y + ay), (x + bx, y + by)
                    kept.add((p, q))
                    spots[p], spots[q] = [float(c) for c in p], [float(c) for c in q]
        shape = planar.as_geometry(planar.polygons_of(planar.rings_of(kept, spots)))
        x, y = min(have)
        return pd.DataFrame({"value": [pdf["value"][0]], "region": [f"{x},{y}"], "cells": [len(pdf)], "wkt": [to_wkt(*shape)]})

    kind = band.schema["value"].dataType.simpleString()
    return own.groupBy("component").applyInPandas(run, f"value {kind}, region string, cells long, wkt string")


def contours(band: DataFrame, levels: Sequence[float]) -> DataFrame:
    """(level, x1, y1, x2, y2): marching squares over cells (x, y, value) as points; a saddle is cut by the mean of its corners."""
    b = band.select("x", "y", F.col("value").cast("double").alias("v"))
    at = lambda dx, dy, n: b.select((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.col("v").alias(n))
    q = at(0, 0, "a").join(at(1, 0, "b"), ["x", "y"]).join(at(1, 1, "c"), ["x", "y"]).join(at(0, 1, "d"), ["x", "y"])
    q = q.withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    up = {n: F.col(n) >= F.col("level") for n in "abcd"}
    along = lambda m, n: (F.col("level") - F.col(m)) / (F.col(n) - F.col(m))
    spot = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    ab, bc = spot(F.col("x") + along("a", "b"), F.col("y")), spot(F.col("x") + 1, F.col("y") + along("b", "c"))
    dc, ad = spot(F.col("x") + along("d", "c"), F.col("y") + 1), spot(F.col("x"), F.col("y") + along("a", "d"))
    pair = lambda p, r: F.struct(p.alias("p"), r.alias("r"))
    code = sum((F.when(up[n], 1 << k).otherwise(0) for k, n in enumerate("abcd")), F.lit(0))
    high = (F.col("a") + F.col("b") + F.col("c") + F.col("d")) / 4 >= F.col("level")
    one = {1: (ad, ab), 14: (ad, ab), 2: (ab, bc), 13: (ab, bc), 4: (bc, dc), 11: (bc, dc), 8: (dc, ad), 7: (dc, ad), 3: (ad, bc), 12: (ad, bc), 6: (ab, dc), 9: (ab, dc)}
    lines = F.when(code.isin(5, 10), F.when((code == 5) == high, F.array(pair(ab, bc), pair(dc, ad))).otherwise(F.array(pair(ad, ab), pair(bc, dc))))
    for c, (p, r) in one.items():
        lines = lines.when(code == c, F.array(pair(p, r)))
    return q.select("level", F.explode(lines).alias("s")).select("level", F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.r.x").alias("x2"), F.col("s.r.y").alias("y2"))


def quadkey(x: Column, y: Column, window: tuple[float, float, float, float], depth: int) -> Column:
    """The digits (0 to 3) of the quadrants of a window that a point lies in, one after another."""
    x1, y1, x2, y2 = window
    cell = lambda v, lo, hi: F.greatest(F.lit(0), F.least(F.lit((1 << depth) - 1), F.floor((v - lo) / F.lit(hi - lo) * F.lit(1 << depth)))).cast("long")
    cx, cy = cell(x, x1, x2), cell(y, y1, y2)
    digit = lambda k: F.shiftrightunsigned(cx, k).bitwiseAND(F.lit(1)) + 2 * F.shiftrightunsigned(cy, k).bitwiseAND(F.lit(1))
    return F.concat(*[digit(k).cast("string") for k in range(depth - 1, -1, -1)])


def quadtree(points: DataFrame, window: tuple[float, float, float, float], capacity: int, depth: int = 12) -> DataFrame:
    """(id, x, y, leaf): a point's leaf is the shortest prefix of its quadkey that at most so many points share (or the whole key)."""
    placed = points.select("id", "x", "y", quadkey(F.col("x"), F.col("y"), window, depth).alias("key"))
    prefixes = placed.groupBy("key").agg(F.count("*").alias("n")).select("n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("k"), "key")
    full = prefixes.groupBy(F.expr("left(key, k)").alias("node")).agg(F.sum("n").alias("n"))
    small = full.where(F.col("n") <= capacity).select("node")
    # of the nodes that are small enough the shortest; keys whose points are too many everywhere stay whole
    keys = placed.select("key").distinct().select("key", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("k")).withColumn("node", F.expr("left(key, k)"))
    leaf = keys.join(small, "node", "left_semi").groupBy("key").agg(F.min("k").alias("k"))
    return placed.join(leaf, "key", "left").select("id", "x", "y", F.expr("left(key, coalesce(k, length(key)))").alias("leaf"))


def packed(points: DataFrame, capacity: int) -> DataFrame:
    """(id, x, y, leaf): leaves of an R-tree by sort-tile-recursive packing: slices by x, and tiles by y in each, of about so many points."""
    n = points.count()
    slices = max(1, math.ceil(math.sqrt(n / capacity)))
    cut = lambda c, p: F.percentile_approx(c, [k / p for k in range(1, p)], 10_000) if p > 1 else F.array().cast("array<double>")
    place = lambda bounds, c: F.aggregate(bounds, F.lit(0), lambda acc, b: acc + (F.col(c) >= b).cast("int"))
    xs = points.agg(cut("x", slices).alias("_bx"))
    sliced = points.select("id", "x", "y").crossJoin(F.broadcast(xs)).withColumn("_s", place(F.col("_bx"), "x")).drop("_bx")
    ys = sliced.groupBy("_s").agg(cut("y", slices).alias("_by"))  # a row for each slice
    tiled = sliced.join(F.broadcast(ys), "_s").withColumn("_t", place(F.col("_by"), "y"))
    return tiled.select("id", "x", "y", (F.col("_s") * slices + F.col("_t")).alias("leaf"))


def leaves(packed_points: DataFrame) -> DataFrame:
    """(leaf, points, box): the boxes of the leaves."""
    return packed_points.groupBy("leaf").agg(F.count("*").alias("points"), extent("x", "y").alias("box"))


def window_search(packed_points: DataFrame, boxes: DataFrame, window: tuple[float, float, float, float]) -> DataFrame:
    """The points in a window: of leaves whose boxes meet it only."""
    box = F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("xmin", "ymin", "xmax", "ymax"), window)])
    near = boxes.where(bbox_intersects(F.col("box"), box)).select("leaf")
    return packed_points.join(F.broadcast(near), "leaf", "left_semi").where((F.col("x").between(window[0], window[2])) & (F.col("y").between(window[1], window[3])))


def transformed(x: Column, y: Column, dx: float = 0.0, dy: float = 0.0, sx: float = 1.0, sy: float = 1.0, degrees: float = 0.0) -> tuple[Column, Column]:
    """Scaled, then turned about the origin, then moved."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return x * sx * c - y * sy * s + dx, x * sx * s + y * sy * c + dy


# --- networks -------------------------------------------------------------------------------------


def shortest_route(edges: Sequence[tuple], start, end, guess: Callable | None = None) -> tuple[float, list]:
    """(cost, path) by Dijkstra, or A* with a lower bound of what is left. For networks that fit one task."""
    out: dict = {}
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
    heap, best = [(guess(start) if guess else 0.0, 0.0, start, [start])], {}
    while heap:
        _, cost, at, path = heapq.heappop(heap)
        if at == end:
            return cost, path
        if best.get(at, math.inf) <= cost:
            continue
        best[at] = cost
        for b, w in out.get(at, []):
            heapq.heappush(heap, (cost + w + (guess(b) if guess else 0.0), cost + w, b, [*path, b]))
    return math.inf, []


def service_area(edges: DataFrame, start, cost: float, weight: str, steps: int = 50) -> DataFrame:
    """(id, distance) of what is reached within a cost."""
    from skeinql.operators.graph import distances

    one = edges.sparkSession.range(1).select(F.lit(start).cast(edges.schema["src"].dataType).alias("id"))
    return distances(edges, one, steps, weight).where(F.col("distance") <= cost).select("id", "distance")


def tour(points: Sequence[tuple[float, float]]) -> list[int]:
    """Nearest neighbour, then 2-opt: an order of the points."""
    d = lambda i, j: math.hypot(points[i][0] - points[j][0], points[i][1] - points[j][1])
    order, left = [0], set(range(1, len(points)))
    while left:
        order.append(min(left, key=lambda j: (d(order[-1], j), j)))
        left.remove(order[-1])
    better = True
    while better:
        better = False
        for i in range(1, len(order) - 1):
            for j in range(i + 1, len(order)):
                a, b, c, e = order[i - 1], order[i], order[j], order[(j + 1) % len(order)]
                if d(a, c) + d(b, e) < d(a, b) + d(c, e) - 1e-12:
                    order[i : j + 1] = order[i : j + 1][::-1]
                    better = True
    return order

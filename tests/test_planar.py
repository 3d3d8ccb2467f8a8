"""Plane geometry: relations, overlays, buffers, simplification and triangulations, the cases that went wrong among them."""

import math
import random

import pytest

from skeinql.operators import planar, spatial

SQUARE = spatial.parse_wkt("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))")


def box(x, y, w, h):
    return "POLYGON", [[[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]]


def size(geometry):
    return sum(planar.ring_area(r) for p in planar.parts(*geometry)[2] for r in p)


HOLED = "POLYGON", [SQUARE[1][0], [[1, 1], [1, 2], [2, 2], [2, 1], [1, 1]]]


def test_intersections_of_all_parts():
    second_inside = "MULTIPOLYGON", [box(100, 100, 1, 1)[1], box(1, 1, 1, 1)[1]]
    line_across = "GEOMETRYCOLLECTION", [("POINT", [50, 50]), ("LINESTRING", [[-1, 2], [9, 2]])]
    for g in (second_inside, line_across):
        assert planar.intersects(SQUARE, g) and planar.intersects(g, SQUARE) and planar.distance(SQUARE, g) == 0
    assert not planar.intersects(HOLED, box(1.2, 1.2, 0.5, 0.5)) and planar.distance(HOLED, ("POINT", [1.5, 1.5])) == 0.5
    assert not planar.intersects(SQUARE, ("POLYGON", [])) and math.isnan(planar.distance(SQUARE, ("POINT", [])))


def test_contains():
    assert not planar.contains(HOLED, box(0.5, 0.5, 2, 2))  # covers the hole
    assert not planar.contains(HOLED, box(1, 1, 1, 1)) and planar.contains(HOLED, box(2, 2, 1, 1))
    assert not any(planar.contains(SQUARE, ("POINT", p)) for p in ([0, 1], [4, 1], [1, 0], [1, 4], [0, 0]))  # borders alike
    assert all(planar.covers(SQUARE, ("POINT", p)) for p in ([0, 1], [4, 1], [1, 0], [1, 4], [0, 0]))
    assert planar.contains(SQUARE, SQUARE) and planar.contains(SQUARE, ("LINESTRING", [[0, 0], [4, 4]])) and not planar.contains(SQUARE, ("LINESTRING", [[0, 0], [4, 0]]))
    assert not planar.contains(SQUARE, ("LINESTRING", [[1, 1], [5, 1]]))


def test_equals_touches_overlaps_crosses():
    turned = "POLYGON", [[[4, 0], [4, 4], [0, 4], [0, 2], [0, 0], [4, 0]]]
    assert planar.equals(SQUARE, turned) and not planar.equals(SQUARE, HOLED)
    assert planar.touches(SQUARE, box(4, 0, 2, 2)) and planar.touches(SQUARE, box(4, 4, 1, 1)) and planar.touches(HOLED, box(1, 1, 1, 1)) and not planar.touches(SQUARE, box(3, 3, 3, 3))
    assert planar.overlaps(SQUARE, box(3, 3, 3, 3)) and not planar.overlaps(SQUARE, box(1, 1, 1, 1)) and not planar.overlaps(SQUARE, box(4, 0, 2, 2))
    assert planar.crosses(SQUARE, ("LINESTRING", [[-1, 2], [9, 2]])) and planar.crosses(("LINESTRING", [[0, 0], [2, 2]]), ("LINESTRING", [[0, 2], [2, 0]]))
    assert planar.overlaps(("LINESTRING", [[0, 0], [2, 0]]), ("LINESTRING", [[1, 0], [3, 0]])) and planar.touches(("LINESTRING", [[0, 0], [2, 0]]), ("LINESTRING", [[2, 0], [3, 5]]))


@pytest.mark.parametrize("seed", range(40))
def test_overlay_areas(seed):
    """Areas of union, intersection and differences add up; points are in a result if the operands say so."""
    rng = random.Random(seed)
    shape = lambda: ("POLYGON", [planar.convex_hull([(rng.random() * 3, rng.random() * 3) for _ in range(rng.randint(3, 9))])])
    a, b = shape(), shape()
    made = {how: planar.combined(how)(a, b) for how in ("union", "intersection", "difference", "symdifference")}
    u, i, d, s = (size(g) for g in made.values())
    assert u + i == pytest.approx(size(a) + size(b)) and d + i == pytest.approx(size(a)) and s + 2 * i == pytest.approx(size(a) + size(b))
    want = {"union": lambda x, y: x or y, "intersection": lambda x, y: x and y, "difference": lambda x, y: x and not y, "symdifference": lambda x, y: x != y}
    for _ in range(30):
        p = [rng.random() * 3, rng.random() * 3]
        x, y = (planar.Shape(*g).locate(p) for g in (a, b))
        if x and y:
            assert all((planar.Shape(*made[how]).locate(p) > 0) == f(x > 0, y > 0) for how, f in want.items())


def test_overlay_of_shapes_with_holes_and_concave_ones():
    assert size(planar.combined("difference")(SQUARE, box(1, 1, 1, 1))) == 15 and size(planar.combined("union")(HOLED, box(1, 1, 1, 1))) == 16
    u = "POLYGON", [[[0, 0], [5, 0], [5, 5], [4, 5], [4, 1], [1, 1], [1, 5], [0, 5], [0, 0]]]
    across = planar.combined("intersection")(u, box(-1, 3, 7, 1))
    assert across[0] == "MULTIPOLYGON" and size(across) == 2
    closed = planar.combined("union")(u, box(0, 4, 5, 1))
    assert len(closed[1]) == 2 and size(closed) == 25 - 9  # the rest of the inside is a hole
    assert planar.combined("intersection")(SQUARE, box(9, 9, 1, 1)) == ("POLYGON", [])


def test_buffer_and_simplify():
    around = planar.buffer(*SQUARE, 1.0, 256)
    assert size(around) == pytest.approx(16 + 16 + math.pi, abs=0.01) and planar.contains(around, SQUARE)
    bent = planar.buffer("LINESTRING", [[0, 0], [10, 0], [10, 10]], 1.0, 256)
    assert planar.contains(bent, ("POINT", [5, 0.9])) and not planar.intersects(bent, ("POINT", [5, 5]))  # no hull
    assert size(bent) == pytest.approx(40 + math.pi + math.pi / 4 - 1, abs=0.01)
    assert len(planar.buffer(*HOLED, 0.2)[1]) == 2 and len(planar.buffer(*HOLED, 0.6)[1]) == 1
    dense = "POLYGON", [[[k / 10, 0] for k in range(41)] + [[4, 4], [0, 4], [0, 0]]]
    assert planar.equals(planar.simplify(*dense, 0.01), SQUARE) and len(planar.simplify(*dense, 0.01)[1][0]) == 5
    assert planar.simplify("LINESTRING", [[0, 0], [1, 0.1], [2, 0], [3, 5]], 0.2, "visvalingam") == ("LINESTRING", [[0, 0], [2, 0], [3, 5]])


def test_triangulation():
    rng = random.Random(3)
    points = [(rng.random(), rng.random()) for _ in range(150)]
    triangles, hull = planar.delaunay(points), planar.convex_hull(points)
    assert len(triangles) == 2 * len(points) - 2 - (len(hull) - 1)
    assert sum(planar.ring_area([points[v] for v in (*t, t[0])]) for t in triangles) == pytest.approx(planar.ring_area(hull))
    cells = planar.voronoi(points, (0, 0, 1, 1))
    assert sum(planar.ring_area(c) for c in cells) == pytest.approx(1)
    for _ in range(200):
        p = (rng.random(), rng.random())
        near = min(range(len(points)), key=lambda i: math.dist(p, points[i]))
        assert planar.Shape("POLYGON", [cells[near]]).locate(p) >= 0
    assert planar.delaunay([(0, 0), (1, 1)]) == [] and len(planar.delaunay([(0, 0), (1, 0), (0, 1), (0, 0)])) == 1


def test_utm_of_a_known_place(spark):
    from pyspark.sql import functions as F

    zone, east, north = spatial.utm(F.lit(43.642567), F.lit(-79.387139))
    got = spark.range(1).select(zone.alias("z"), east.alias("e"), north.alias("n")).first()
    assert got.z == 17 and abs(got.e - 630084) < 1 and abs(got.n - 4833438) < 1  # the CN Tower


def test_kmeans_is_lloyd(spark):
    rng = random.Random(2)
    rows = [(i, rng.gauss(c, 0.3), rng.gauss(2 * c, 0.3)) for i, c in enumerate([0, 5, 10] * 40)]
    got = {r.id: r.cluster for r in spatial.kmeans(spark.createDataFrame(rows, "id long, x double, y double"), 3).collect()}
    groups = {}
    for i, x, y in rows:
        groups.setdefault(got[i], []).append((x, y))
    means = {c: (sum(p[0] for p in own) / len(own), sum(p[1] for p in own) / len(own)) for c, own in groups.items()}
    assert all(got[i] == min(means, key=lambda c: math.dist(means[c], (x, y))) for i, x, y in rows)

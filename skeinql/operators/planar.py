"""Plane geometry on (type, coordinates) pairs: where points lie, how geometries relate, and overlays of polygons.

Segments of both geometries are cut at each other, so every piece lies wholly inside, on the border of, or
outside of the other geometry, and its middle tells which. Predicates ask for such pieces, overlays keep some
and join them to rings.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterable, Sequence

#: Points nearer than this share of the coordinates' size are one.
NEAR = 1e-9

Point = Sequence[float]
Segment = tuple[Point, Point]


def parts(kind: str, data: list) -> tuple[list, list, list]:
    """(points, lines, polygons) of a geometry, collections taken apart."""
    if not data:
        return [], [], []
    if kind == "POINT":
        return [data], [], []
    if kind == "MULTIPOINT":
        return list(data), [], []
    if kind in ("LINESTRING", "CIRCULARSTRING"):
        return [], [data], []
    if kind == "MULTILINESTRING":
        return [], list(data), []
    if kind == "POLYGON":
        return [], [], [data]
    if kind == "MULTIPOLYGON":
        return [], [], list(data)
    out: tuple[list, list, list] = ([], [], [])
    for g in data:
        for have, more in zip(out, parts(*g)):
            have += more
    return out


def _pairs(line: list) -> list[Segment]:
    return [(a, b) for a, b in zip(line, line[1:]) if tuple(a[:2]) != tuple(b[:2])]


def cross(a: Point, b: Point, c: Point) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def to_segment(p: Point, a: Point, b: Point) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = 0.0 if dx == dy == 0 else max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


class Shape:
    """A geometry taken apart: isolated points, lines, polygons, and all their segments."""

    def __init__(self, kind: str, data: list) -> None:
        self.points, self.lines, self.polygons = parts(kind, data)
        self.line_segments = [s for line in self.lines for s in _pairs(line)]
        self.ring_segments = [s for p in self.polygons for ring in p for s in _pairs(ring)]
        self.segments = self.line_segments + self.ring_segments
        self.vertices = [*self.points, *(p for line in self.lines for p in line), *(p for poly in self.polygons for ring in poly for p in ring)]
        ends: dict[tuple, int] = defaultdict(int)
        for line in self.lines:
            if line and tuple(line[0][:2]) != tuple(line[-1][:2]):
                for p in (line[0], line[-1]):
                    ends[tuple(p[:2])] += 1
        #: Ends of an odd number of lines are their border.
        self.ends = [p for p, n in ends.items() if n % 2]
        self.near = NEAR * max([1.0, *(abs(c) for p in self.vertices for c in p[:2])])
        self.dimension = 2 if self.polygons else 1 if self.lines else 0 if self.points else -1

    def locate(self, p: Point) -> int:
        """1 inside, 0 on the border, -1 outside."""
        best = -1
        for poly in self.polygons:
            if any(to_segment(p, *s) <= self.near for ring in poly for s in _pairs(ring)):
                best = max(best, 0)
            elif _in_rings(p, poly):
                return 1
        if any(to_segment(p, *s) <= self.near for s in self.line_segments):
            best = max(best, 0 if any(math.dist(p[:2], e) <= self.near for e in self.ends) else 1)
        if any(math.dist(p[:2], q[:2]) <= self.near for q in self.points):
            best = 1
        return best


def _in_rings(p: Point, rings: Iterable[list]) -> bool:
    """Even-odd rule over all rings, holes among them."""
    inside = False
    for ring in rings:
        for (x1, y1), (x2, y2) in ((a[:2], b[:2]) for a, b in zip(ring, ring[1:])):
            if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
                inside = not inside
    return inside


def cuts(s: Segment, t: Segment, near: float) -> list[Point]:
    """Where two segments meet: no point, one, or the two ends of what they share."""
    (a, b), (c, d) = s, t
    if max(a[0], b[0]) < min(c[0], d[0]) - near or max(c[0], d[0]) < min(a[0], b[0]) - near or max(a[1], b[1]) < min(c[1], d[1]) - near or max(c[1], d[1]) < min(a[1], b[1]) - near:
        return []
    out = [p for p, q in ((a, t), (b, t), (c, s), (d, s)) if to_segment(p, *q) <= near]
    if out:
        return out
    d1, d2, d3, d4 = cross(c, d, a), cross(c, d, b), cross(a, b, c), cross(a, b, d)
    if (d1 > 0) != (d2 > 0) and (d3 > 0) != (d4 > 0):
        u = d1 / (d1 - d2)
        return [[a[0] + u * (b[0] - a[0]), a[1] + u * (b[1] - a[1])]]
    return []


def pieces(segments: list[Segment], shape: Shape) -> list[Segment]:
    """Segments cut wherever a shape's segments or points meet them."""
    out = []
    for a, b in segments:
        at = [p for t in shape.segments for p in cuts((a, b), t, shape.near)] + [p for p in shape.points if to_segment(p, a, b) <= shape.near]
        size = math.dist(a[:2], b[:2])
        along = sorted({0.0, 1.0, *(min(1.0, max(0.0, math.dist(a[:2], p[:2]) / size)) for p in at)})
        spots = [a if u == 0 else b if u == 1 else [a[0] + u * (b[0] - a[0]), a[1] + u * (b[1] - a[1])] for u in along]
        out += [(p, q) for p, q in zip(spots, spots[1:]) if math.dist(p[:2], q[:2]) > shape.near]
    return out


def _middle(s: Segment) -> Point:
    return [(s[0][0] + s[1][0]) / 2, (s[0][1] + s[1][1]) / 2]


def _interior_point(poly: list) -> Point:
    """A point inside of a polygon: the middle of the widest stretch of a line through it."""
    ys = sorted({p[1] for ring in poly for p in ring})
    best: tuple[float, Point] = (-1.0, poly[0][0])
    for lo, hi in zip(ys, ys[1:]):
        y = (lo + hi) / 2
        xs = sorted(a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for ring in poly for a, b in _pairs(ring) if (a[1] > y) != (b[1] > y))
        for x1, x2 in zip(xs[::2], xs[1::2]):
            best = max(best, (x2 - x1, [(x1 + x2) / 2, y]))
    return best[1]


def _meet(a: Shape, b: Shape) -> bool:
    if a.dimension < 0 or b.dimension < 0:
        return False
    if any(cuts(s, t, max(a.near, b.near)) for s in a.segments for t in b.segments):
        return True
    starts = lambda x: [*x.points, *(line[0] for line in x.lines), *(ring[0] for poly in x.polygons for ring in poly)]
    return any(b.locate(p) >= 0 for p in starts(a)) or any(a.locate(p) >= 0 for p in starts(b))


def _inside_meet(a: Shape, b: Shape) -> bool:
    """Whether the interiors have a point in common."""
    for x, y in ((a, b), (b, a)):
        if any(y.locate(p) == 1 for p in x.points) or any(y.locate(_middle(s)) == 1 for s in pieces(x.line_segments, y)):
            return True
        if y.polygons and any(_areas(y).locate(_middle(s)) == 1 for s in pieces(x.ring_segments, y)):
            return True
        if y.polygons and any(_areas(y).locate(_interior_point(p)) == 1 for p in x.polygons):
            return True
    near = max(a.near, b.near)
    return any(a.locate(p) == 1 and b.locate(p) == 1 for s in a.line_segments for t in b.line_segments for p in cuts(s, t, near))


def _areas(x: Shape) -> Shape:
    return Shape("MULTIPOLYGON", x.polygons)


def _covers(a: Shape, b: Shape) -> bool:
    """No point of b is outside of a."""
    if a.dimension < b.dimension or b.dimension < 0:
        return False
    if any(a.locate(p) < 0 for p in b.points) or any(a.locate(_middle(s)) < 0 for s in pieces(b.segments, a)):
        return False
    if b.polygons:
        areas = _areas(b)
        # where a's border runs inside of b, b goes on outside of a
        if any(areas.locate(_middle(s)) == 1 for s in pieces(a.ring_segments, b)):
            return False
        return all(_areas(a).locate(_interior_point(p)) >= 0 for p in b.polygons)
    return True


def intersects(a, b) -> bool:
    return _meet(Shape(*a), Shape(*b))


def covers(a, b) -> bool:
    return _covers(Shape(*a), Shape(*b))


def contains(a, b) -> bool:
    """No point of b is outside of a, and their interiors meet: what lies only on a's border is not contained."""
    x, y = Shape(*a), Shape(*b)
    return _covers(x, y) and _inside_meet(x, y)


def equals(a, b) -> bool:
    """The same points, however they are written."""
    x, y = Shape(*a), Shape(*b)
    return x.dimension == y.dimension and (x.dimension < 0 or _covers(x, y) and _covers(y, x))


def touches(a, b) -> bool:
    """They meet, but only at their borders."""
    x, y = Shape(*a), Shape(*b)
    return _meet(x, y) and not _inside_meet(x, y)


def overlaps(a, b) -> bool:
    """Of one dimension, sharing some of it, and neither covering the other."""
    x, y = Shape(*a), Shape(*b)
    if x.dimension != y.dimension or not _inside_meet(x, y) or _covers(x, y) or _covers(y, x):
        return False
    return x.dimension != 1 or any(y.locate(_middle(s)) == 1 for s in pieces(x.line_segments, y))


def crosses(a, b) -> bool:
    """Interiors meet in less than the greater dimension of both, and neither covers the other."""
    x, y = Shape(*a), Shape(*b)
    if not _inside_meet(x, y) or _covers(x, y) or _covers(y, x):
        return False
    return x.dimension != y.dimension or x.dimension == 1 and not any(y.locate(_middle(s)) == 1 for s in pieces(x.line_segments, y))


def distance(a, b) -> float:
    x, y = Shape(*a), Shape(*b)
    if x.dimension < 0 or y.dimension < 0:
        return math.nan
    if _meet(x, y):
        return 0.0
    best = min((math.dist(p[:2], q[:2]) for p in x.vertices for q in y.vertices), default=math.inf)
    for u, v in ((x, y), (y, x)):
        best = min([best, *(to_segment(p, *s) for p in u.vertices for s in v.segments)])
    return best


# --- overlays -------------------------------------------------------------------------------------


def ring_area(ring: list) -> float:
    """Positive counter-clockwise."""
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:])) / 2


def _directed(polygons: list) -> list[Segment]:
    """Segments with the inside to the left."""
    out = []
    for poly in polygons:
        for k, ring in enumerate(poly):
            out += _pairs(ring if (ring_area(ring) > 0) == (k == 0) else ring[::-1])
    return out


def overlay(a: list, b: list, how: str) -> list:
    """Polygons (lists of rings, the outer one first) of the union, intersection, difference or symdifference of two lists of polygons."""
    if how == "symdifference":
        return overlay(overlay(a, b, "difference"), overlay(b, a, "difference"), "union")
    x, y = Shape("MULTIPOLYGON", a), Shape("MULTIPOLYGON", b)
    near = max(x.near, y.near)
    key = lambda p: (round(p[0] / near / 8), round(p[1] / near / 8))
    spots: dict[tuple, Point] = {}

    def name(p: Point) -> tuple:
        k = key(p)
        for dx in (0, -1, 1):
            for dy in (0, -1, 1):
                if (k[0] + dx, k[1] + dy) in spots:
                    return (k[0] + dx, k[1] + dy)
        spots[k] = [float(p[0]), float(p[1])]
        return k

    kept: set[tuple] = set()
    of = {}
    for n, (own, other) in enumerate(((x, y), (y, x))):
        of[n] = [(name(p), name(q), other.locate(_middle((p, q)))) for p, q in pieces(_directed(own.polygons), other)]
    shared = [{(p, q) for p, q, where in of[n] if where == 0} for n in (0, 1)]
    for n in (0, 1):
        for p, q, where in of[n]:
            if p == q:
                continue
            if where == 0:
                alike = (p, q) in shared[1 - n]
                if n == 0 and alike == (how != "difference"):
                    kept.add((p, q))
            elif how == "union" and where < 0 or how == "intersection" and where > 0 or how == "difference" and n == 0 and where < 0:
                kept.add((p, q))
            elif how == "difference" and n == 1 and where > 0:
                kept.add((q, p))
    return polygons_of(rings_of(kept, spots))


def rings_of(edges: set[tuple], spots: dict[tuple, Point]) -> list[list]:
    """Closed rings of directed edges with the inside to the left; at a crossing the sharpest turn to the left is taken."""
    out: dict[tuple, list[tuple]] = defaultdict(list)
    for p, q in edges:
        out[p].append(q)
    angle = lambda p, q: math.atan2(spots[q][1] - spots[p][1], spots[q][0] - spots[p][0])
    rings, left = [], set(edges)
    while left:
        first = min(left)
        path, at = [first[0]], first
        while True:
            left.discard(at)
            p, q = at
            path.append(q)
            if q == first[0]:
                break
            back = angle(q, p)
            ahead = [r for r in out[q] if (q, r) in left]
            if not ahead:
                break
            r = min(ahead, key=lambda r: (back - angle(q, r)) % (2 * math.pi) or 2 * math.pi)
            at = (q, r)
        if path[0] == path[-1] and len(path) > 3:
            rings.append(_straightened([spots[p] for p in path]))
    return [r for r in rings if len(r) > 3 and abs(ring_area(r)) > 0]


def _straightened(ring: list) -> list:
    """A ring without points on a straight line between their neighbours."""
    body = ring[:-1]
    size = max([1.0, *(abs(c) for p in body for c in p)])
    keep = [p for i, p in enumerate(body) if abs(cross(body[i - 1], p, body[(i + 1) % len(body)])) > NEAR * size * max(1e-12, math.dist(body[i - 1], body[(i + 1) % len(body)]))]
    return [list(p) for p in [*keep, keep[0]]] if len(keep) > 2 else []


def polygons_of(rings: list[list]) -> list:
    """Polygons of rings: each clockwise one is a hole of the smallest counter-clockwise one around it."""
    outer = sorted((r for r in rings if ring_area(r) > 0), key=ring_area)
    out = [[r] for r in outer]
    for hole in (r for r in rings if ring_area(r) < 0):
        p = _interior_point([hole])
        for poly in out:
            if _in_rings(p, poly[:1]):
                poly.append(hole)
                break
    return out


def as_geometry(polygons: list) -> tuple[str, list]:
    if not polygons:
        return "POLYGON", []
    return ("POLYGON", polygons[0]) if len(polygons) == 1 else ("MULTIPOLYGON", polygons)


def merged(polygons: list) -> list:
    """The union of many polygons, two and two."""
    todo = [[p] for p in polygons]
    while len(todo) > 1:
        todo = [overlay(*todo[i : i + 2], "union") if i + 1 < len(todo) else todo[i] for i in range(0, len(todo), 2)]
    return todo[0] if todo else []


def combined(how: str) -> Callable:
    return lambda a, b: as_geometry(overlay(parts(*a)[2], parts(*b)[2], how))


def buffer(kind: str, data: list, radius: float, segments: int = 32) -> tuple[str, list]:
    """All points at most radius away: discs about the points, stretches along the segments and the polygons themselves, joined. Arcs have so many segments a turn."""
    s = Shape(kind, data)
    disc = lambda p: [[p[0] + radius * math.cos(2 * math.pi * i / segments), p[1] + radius * math.sin(2 * math.pi * i / segments)] for i in range(segments)]
    closed = lambda ring: [*ring, ring[0]]
    out = [[closed(disc(p))] for p in s.points]
    for a, b in s.segments:
        # the hull of both discs, in one step: half a disc at each end
        turn = math.atan2(b[1] - a[1], b[0] - a[0])
        half = lambda c, start: [[c[0] + radius * math.cos(start + math.pi * i / (segments // 2)), c[1] + radius * math.sin(start + math.pi * i / (segments // 2))] for i in range(segments // 2 + 1)]
        out.append([closed(half(b, turn - math.pi / 2) + half(a, turn + math.pi / 2))])
    return as_geometry(merged([*out, *s.polygons]))


def _peucker(line: list, tolerance: float) -> list:
    keep, todo = {0, len(line) - 1}, [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        far = max(((to_segment(line[i], line[a], line[b]), i) for i in range(a + 1, b)), default=(0.0, a))
        if far[0] > tolerance:
            keep.add(far[1])
            todo += [(a, far[1]), (far[1], b)]
    return [line[i] for i in sorted(keep)]


def _visvalingam(line: list, least: float, closed: bool) -> list:
    """Points go in the order of the area of the triangle with their neighbours, while it is below the least."""
    out = list(line)
    while len(out) > (4 if closed else 2):
        area, i = min((abs(cross(out[i - 1], out[i], out[i + 1])) / 2, i) for i in range(1, len(out) - 1))
        if area >= least:
            break
        del out[i]
    return out


def simplify(kind: str, data: list, tolerance: float, method: str = "douglas-peucker") -> tuple[str, list]:
    """Fewer points, of lines and of the rings of polygons; a ring that vanishes goes, a polygon with its outer ring."""

    def one(line: list, closed: bool) -> list:
        if method == "visvalingam":
            return _visvalingam(line, tolerance, closed)
        if not closed:
            return _peucker(line, tolerance)
        # a ring is cut at the point farthest from its first
        far = max(range(len(line)), key=lambda i: math.dist(line[0][:2], line[i][:2]))
        return _peucker(line[: far + 1], tolerance) + _peucker(line[far:], tolerance)[1:]

    def polygon(poly: list) -> list:
        rings = [one(r, True) for r in poly]
        return [r for k, r in enumerate(rings) if len(r) > 3 and (k == 0 or len(rings[0]) > 3)]

    if kind == "LINESTRING":
        return kind, one(data, False)
    if kind == "MULTILINESTRING":
        return kind, [one(line, False) for line in data]
    if kind == "POLYGON":
        return kind, polygon(data)
    if kind == "MULTIPOLYGON":
        return kind, [p for p in map(polygon, data) if p]
    if kind == "GEOMETRYCOLLECTION":
        return kind, [simplify(*g, tolerance, method) for g in data]
    return kind, data


# --- triangulation --------------------------------------------------------------------------------


def _circle(a: Point, b: Point, c: Point) -> tuple[float, float, float]:
    """(x, y, squared radius) of the circle through three points."""
    bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
    d = 2 * (bx * cy - by * cx)
    ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
    return a[0] + ux, a[1] + uy, ux * ux + uy * uy


def delaunay(points: Sequence[Point]) -> list[tuple[int, int, int]]:
    """Triangles (counter-clockwise numbers of points) whose circles hold no other point, by inserting points one after another."""
    first: dict[tuple, int] = {}
    for i, p in enumerate(points):
        first.setdefault((float(p[0]), float(p[1])), i)
    spots = sorted(first)
    if len(spots) < 3:
        return []
    xs, ys = [p[0] for p in spots], [p[1] for p in spots]
    mid, span = ((min(xs) + max(xs)) / 2, (min(ys) + max(ys)) / 2), 1e4 * max(max(xs) - min(xs), max(ys) - min(ys), 1e-9)
    n = len(spots)
    at = [*spots, (mid[0] - 2 * span, mid[1] - span), (mid[0] + 2 * span, mid[1] - span), (mid[0], mid[1] + 2 * span)]
    circles = {(n, n + 1, n + 2): _circle(at[n], at[n + 1], at[n + 2])}
    for i in range(n):
        p = at[i]
        bad = [t for t, (x, y, r) in circles.items() if (p[0] - x) ** 2 + (p[1] - y) ** 2 < r * (1 - 1e-12)]
        border: dict[tuple[int, int], int] = {}
        for t in bad:
            del circles[t]
            for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                if border.pop(e[::-1], None) is None:
                    border[e] = 1
        for a, b in border:
            if abs(cross(at[a], at[b], p)) > 0:
                circles[(a, b, i)] = _circle(at[a], at[b], p)
    return sorted(tuple(first[spots[v]] for v in t) for t in circles if max(t) < n)


def convex_hull(points: Iterable[Point]) -> list:
    """Closed ring, counter-clockwise (monotone chain)."""
    ps = sorted({(float(p[0]), float(p[1])) for p in points})
    if len(ps) < 3:
        return [list(p) for p in ps]
    half = []
    for run in (ps, ps[::-1]):
        chain: list = []
        for p in run:
            while len(chain) > 1 and cross(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        half.append(chain[:-1])
    ring = half[0] + half[1]
    return [list(p) for p in [*ring, ring[0]]]


def half_plane(ring: list, a: Point, b: Point) -> list:
    """The part of a convex ring to the left of the line from a to b."""
    body, out = ring[:-1], []
    for i, p in enumerate(body):
        q = body[i - 1]
        sp, sq = cross(a, b, p), cross(a, b, q)
        if (sp >= 0) != (sq >= 0):
            t = sq / (sq - sp)
            out.append([q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])])
        if sp >= 0:
            out.append(list(p[:2]))
    return [*out, out[0]] if len(out) > 2 else []


def voronoi(points: Sequence[Point], window: tuple[float, float, float, float]) -> list[list]:
    """For each point the ring of all that is nearer to it than to any other, inside of a window (xmin, ymin, xmax, ymax)."""
    near: dict[int, set[int]] = defaultdict(set)
    for t in delaunay(points):
        for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
            near[a].add(b)
            near[b].add(a)
    x1, y1, x2, y2 = window
    out = []
    for i, p in enumerate(points):
        cell = [[x1, y1], [x2, y1], [x2, y2], [x1, y2], [x1, y1]]
        for j in near.get(i) or [k for k in range(len(points)) if tuple(points[k][:2]) != tuple(p[:2])]:
            q = points[j]
            m, d = ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2), (q[0] - p[0], q[1] - p[1])
            cell = half_plane(cell, m, (m[0] - d[1], m[1] + d[0])) if cell else cell
        out.append(cell)
    return out

"""Hyperedges, temporal metrics, recommendation by content, compressed adjacency, and a pattern language over property graphs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# --- hyperedges: (edge, vertex) rows --------------------------------------------------------------


#: Rows of a task that pairs the vertices of an edge.
MEMBER_ROWS = 500_000


def _pairs(members: DataFrame) -> tuple[DataFrame, int]:
    """((src, dst) for each edge that has both, src < dst; tasks): equal pairs are in one task. Tasks grow in number with the rows, not in size."""
    n = members.count() // MEMBER_ROWS + 1
    one = members.select("edge", "vertex")
    one = (one.repartition(n, "edge") if n > 1 else one).distinct()
    pairs = one.select("edge", F.col("vertex").alias("src")).join(one.select("edge", F.col("vertex").alias("dst")), "edge").where("src < dst").select("src", "dst")
    # not aggregated before the exchange, where each task would keep all of its own
    return (pairs.repartition(4 * n, "src", "dst") if n > 1 else pairs), n


def hyper_degrees(members: DataFrame) -> DataFrame:
    """(vertex, degree, neighbours): edges of each vertex, and other vertices that share one."""
    pairs, n = _pairs(members)
    near = pairs.distinct().select(F.explode(F.array("src", "dst")).alias("vertex")).groupBy("vertex").agg(F.count("*").alias("neighbours"))
    one = members.select("edge", "vertex")
    one = (one.repartition(n, "edge", "vertex") if n > 1 else one).distinct()
    return one.groupBy("vertex").agg(F.count("*").alias("degree")).join(near, "vertex", "left").fillna(0, ["neighbours"])


def incident(members: DataFrame, vertices: Sequence) -> DataFrame:
    """(edge) of the edges that hold all of some vertices."""
    found = members.where(F.col("vertex").isin(list(vertices))).groupBy("edge").agg(F.count_distinct("vertex").alias("n"))
    return found.where(F.col("n") == len(set(vertices))).select("edge")


def clique_expansion(members: DataFrame) -> DataFrame:
    """(src, dst, weight): vertices of a common hyperedge, src < dst; weight: how many they share."""
    return _pairs(members)[0].groupBy("src", "dst").agg(F.count("*").alias("weight"))


def star_expansion(members: DataFrame) -> DataFrame:
    """(src, dst): each hyperedge a vertex of its own ('e' and its id), joined to its members ('v' and theirs)."""
    return members.select(F.concat(F.lit("e"), F.col("edge").cast("string")).alias("src"), F.concat(F.lit("v"), F.col("vertex").cast("string")).alias("dst")).distinct()


# --- time -----------------------------------------------------------------------------------------


def activity(edges: DataFrame, ts: str, every: str) -> DataFrame:
    """(start, vertices, edges, new_edges): what a temporal graph has in each window, and edges (src, dst) seen for the first time."""
    first = edges.withColumn("_first", F.row_number().over(Window.partitionBy("src", "dst").orderBy(ts)) == 1)
    w = F.window(ts, every)["start"].alias("start")
    counts = first.groupBy(w).agg(F.count("*").alias("edges"), F.count_if("_first").alias("new_edges"))
    ends = edges.select(w, F.col("src").alias("v")).union(edges.select(w, F.col("dst").alias("v"))).groupBy("start").agg(F.count_distinct("v").alias("vertices"))
    return counts.join(ends, "start").select("start", "vertices", "edges", "new_edges")


def gaps(edges: DataFrame, ts: str) -> DataFrame:
    """(id, contacts, mean_gap): seconds between the edges of a vertex, on average, and how many it has."""
    ends = edges.select(F.col("src").alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).union(edges.select("dst", F.unix_micros(F.col(ts).cast("timestamp"))))
    return ends.groupBy("id").agg(F.count("*").alias("contacts"), ((F.max("t") - F.min("t")) / F.nullif(F.count("*") - 1, F.lit(0)) / 1e6).alias("mean_gap"))


def earliest_arrival(edges: DataFrame, start, ts: str, rounds: int = 50) -> DataFrame:
    """(id, at): when each vertex can be reached from one, along edges whose times do not fall."""
    from skeinql.operators.graph import _cut

    e = _cut(edges.select("src", "dst", F.col(ts).alias("t")))
    kind = edges.schema["src"].dataType
    best = _cut(e.sparkSession.range(1).select(F.lit(start).cast(kind).alias("id"), F.lit(None).cast(edges.schema[ts].dataType).alias("at")))
    front = best
    for _ in range(rounds):
        step = e.join(front.withColumnRenamed("id", "src"), "src").where("at IS NULL OR t >= at").groupBy(F.col("dst").alias("id")).agg(F.min("t").alias("new"))
        front = _cut(step.join(best, "id", "left").where(f"id <> '{start}' AND (at IS NULL OR new < at)").select("id", F.col("new").alias("at")))
        if front.isEmpty():
            break
        best = _cut(best.join(front.select("id"), "id", "left_anti").union(front))
    return best


# --- recommendation -------------------------------------------------------------------------------


def similar_items(items: DataFrame, liked: Sequence, k: int) -> DataFrame:
    """(id, score): items (id, features array<double>) nearest by cosine to the mean of those liked, without these; ties by id."""
    mean = items.where(F.col("id").isin(list(liked))).select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
    profile = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("p"))  # one vector
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(dot(a, a))
    x = items.where(~F.col("id").isin(list(liked))).crossJoin(F.broadcast(profile))
    score = dot(F.col("features"), F.col("p")) / F.nullif(norm(F.col("features")) * norm(F.col("p")), F.lit(0.0))
    return x.select("id", F.coalesce(score, F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "id").limit(k)


# --- storage --------------------------------------------------------------------------------------


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, neighbours): sorted lists of where edges go."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))


def compressed_rows(edges: DataFrame) -> DataFrame:
    """(id, offset, length): where each vertex's neighbours begin in a list of all edges ordered by (src, dst), as in a CSR matrix."""
    rows = edges.select("src", "dst").distinct().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("length"))
    before = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"), "length")


# --- patterns -------------------------------------------------------------------------------------

_NODE = r"\(\s*(\w+)\s*(?::\s*(\w+))?\s*\)"
_EDGE = r"(<?)-(?:\[\s*(\w+)?\s*(?::\s*(\w+))?\s*(?:\*\s*(\d+)\s*\.\.\s*(\d+))?\s*\])?-(>?)"


def query(vertices: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    """MATCH (a:Label)-[e:type]->(b), (b)-[:type*1..3]->(c) WHERE ... RETURN ... [ORDER BY ...] [LIMIT n].

    vertices: id, label, properties; edges: src, dst, label, properties. a.x in WHERE and RETURN is a property
    of what is bound to a; expressions are Spark SQL. -> and <- give the direction, -- either. *m..n is a path
    of so many edges without a vertex twice (it binds no edge). The same variable is the same vertex.
    """
    m = re.fullmatch(r"\s*MATCH\s+(.*?)(?:\s+WHERE\s+(.*?))?\s+RETURN\s+(DISTINCT\s+)?(.*?)(?:\s+ORDER\s+BY\s+(.*?))?(?:\s+LIMIT\s+(\d+))?\s*", text, re.S | re.I)
    if not m:
        raise ValueError("not MATCH ... RETURN ...")
    out: DataFrame | None = None
    bound: set[str] = set()

    def node(name: str, label: str | None) -> DataFrame:
        own = vertices if label is None else vertices.where(F.col("label") == label)
        return own.select(F.struct(*vertices.columns).alias(name))

    def add(rows: DataFrame, condition: list[Column]) -> DataFrame:
        return rows if out is None else out.join(rows, condition) if condition else out.crossJoin(rows)

    for path in re.split(r",(?=\s*\()", m[1]):
        at, last = 0, None
        while at < len(path.rstrip()):
            found = re.compile(r"\s*" + _NODE).match(path, at)
            if not found:
                raise ValueError(f"no vertex at {path[at:]!r}")
            name, label = found[1], found[2]
            if last is None:
                if name not in bound:
                    out = add(node(name, label), [])
                elif label:
                    out = out.where(F.col(f"{name}.label") == label)
            else:
                left, e = last
                out = _step(out, vertices, edges, left, e, name, label, bound)
            bound.add(name)
            at = found.end()
            step = re.compile(r"\s*" + _EDGE).match(path, at)
            last = (name, step) if step else None
            at = step.end() if step else at
            if not step and path[at:].strip():
                raise ValueError(f"no edge at {path[at:]!r}")
    out = out if m[2] is None else out.where(m[2])
    columns = [c.strip() for c in re.split(r",(?![^()]*\))", m[4])]
    grouped = [c for c in columns if re.match(r"(count|sum|avg|min|max)\s*\(", c, re.I)]
    named = [c if re.search(r"\s+AS\s+\w+$", c, re.I) else f"{c} AS {re.sub(r'[^0-9A-Za-z_]', '_', c)}" for c in columns]
    if grouped:
        keys = [F.expr(n.rsplit(" AS ", 1)[0] if " AS " in n else re.split(r"\s+as\s+", n, flags=re.I)[0]).alias(re.split(r"\s+as\s+", n, flags=re.I)[-1]) for c, n in zip(columns, named) if c not in grouped]
        aggs = [F.expr(re.split(r"\s+as\s+", n, flags=re.I)[0]).alias(re.split(r"\s+as\s+", n, flags=re.I)[-1]) for c, n in zip(columns, named) if c in grouped]
        out = out.groupBy(*keys).agg(*aggs)
    else:
        out = out.selectExpr(*named)
    out = out.distinct() if m[3] else out
    if m[5]:
        out = out.orderBy(*[F.expr(re.sub(r"\s+(ASC|DESC)$", "", c.strip(), flags=re.I)).desc() if re.search(r"\s+DESC$", c.strip(), re.I) else F.expr(re.sub(r"\s+ASC$", "", c.strip(), flags=re.I)).asc() for c in m[5].split(",")])
    return out.limit(int(m[6])) if m[6] else out


def _step(out: DataFrame, vertices: DataFrame, edges: DataFrame, left: str, e: re.Match, name: str, label: str | None, bound: set[str]) -> DataFrame:
    back, own, kind, low, high, ahead = e[1], e[2], e[3], e[4], e[5], e[6]
    some = edges if kind is None else edges.where(F.col("label") == kind)
    both = some.select(F.struct(*edges.columns).alias("_e"), F.col("src").alias("_a"), F.col("dst").alias("_b"))
    turned = some.select(F.struct(*edges.columns).alias("_e"), F.col("dst").alias("_a"), F.col("src").alias("_b"))
    links = turned if back and not ahead else both if ahead and not back else both.union(turned)
    if low:
        paths = found = links.select("_a", "_b", F.array("_a", "_b").alias("_p")).where("_a <> _b")
        hops = [found] if int(low) <= 1 else []
        for k in range(2, int(high) + 1):
            more = paths.select("_a", F.col("_b").alias("_m"), "_p").join(links.select(F.col("_a").alias("_m"), "_b"), "_m").where(~F.array_contains("_p", F.col("_b")))
            paths = more.select("_a", "_b", F.concat("_p", F.array("_b")).alias("_p"))
            if k >= int(low):
                hops.append(paths)
        links = hops[0]
        for h in hops[1:]:
            links = links.union(h)
        links = links.select(F.lit(None).alias("_e"), "_a", "_b")
    links = links.withColumnRenamed("_e", own or "_unnamed")
    links = links if own and not low else links.drop(own or "_unnamed")
    out = out.join(links, F.col(f"{left}.id") == F.col("_a"))
    if name in bound:
        out = out.where(F.col(f"{name}.id") == F.col("_b"))
        return (out.where(F.col(f"{name}.label") == label) if label else out).drop("_a", "_b")
    near = vertices if label is None else vertices.where(F.col("label") == label)
    near = near.select(F.struct(*vertices.columns).alias(name), F.col("id").alias("_id"))
    return out.join(near, F.col("_b") == F.col("_id")).drop("_a", "_b", "_id")

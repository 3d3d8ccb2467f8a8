"""Property graphs as vertex (id, ...) and edge (src, dst, ...) tables.

Iterative algorithms are joins and aggregates in a loop; each round's table is cut off with checkpoint()
and only a convergence number comes to the driver. Algorithms that need all paths from each vertex
(betweenness, closeness, k shortest paths) go as far as the graph does unless a depth is given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from skeinql.operators.adjacency import meetings
from skeinql.session import scratch, shared_folder

#: Edges of one list.
LIST_EDGES = 100_000


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, once."""
    e = edges.select("src", "dst").where("src <> dst")
    return e.union(e.select("dst", "src")).distinct()


def neighbors(edges: DataFrame, vertex, direction: str = "out") -> DataFrame:
    out = edges.where(F.col("src") == vertex).select(F.col("dst").alias("id"))
    into = edges.where(F.col("dst") == vertex).select(F.col("src").alias("id"))
    return {"out": out, "in": into, "all": out.union(into)}[direction].distinct()


def with_label(vertices: DataFrame, label: str) -> DataFrame:
    return vertices.where(F.array_contains("labels", label))


def from_tables(rows: DataFrame, key: str, foreign: str, label: str) -> DataFrame:
    """Edges of a foreign key: from the row to what it refers to."""
    return rows.where(F.col(foreign).isNotNull()).select(F.col(key).alias("src"), F.col(foreign).alias("dst"), F.lit(label).alias("label"))


def match(edges: DataFrame, steps: Sequence[tuple[str, str | None, str]]) -> DataFrame:
    """Bindings of a chain or other pattern: steps of (variable, edge label or None, variable)."""
    out: DataFrame | None = None
    for a, label, b in steps:
        e = edges if label is None else edges.where(F.col("label") == label)
        e = e.select(F.col("src").alias(a), F.col("dst").alias(b)) if a != b else e.where("src = dst").select(F.col("src").alias(a))
        out = e if out is None else out.join(e, [c for c in {a, b} if c in out.columns]) if {a, b} & set(out.columns) else out.crossJoin(e)
    return out


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree, degree)."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count("*").alias("degree"))


def degree_centrality(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    n = vertices.count()
    return vertices.select("id").join(degrees(edges), "id", "left").select("id", (F.coalesce("degree", F.lit(0)) / F.lit(max(n - 1, 1))).alias("centrality"))


def kept(edges: DataFrame) -> DataFrame:
    """(src, dst) as written to the shared folder, so that edges which are dear to make are made once, however often they are read."""
    spark, path = edges.sparkSession, scratch(edges.sparkSession, "edges")
    e = edges.select("src", "dst")
    e.write.parquet(path)
    return spark.read.schema(e.schema).parquet(path)


def _lists(edges: DataFrame) -> DataFrame:
    """(src, d, dsts): all that a vertex points to, in lists of bounded length, and how many edges that is (those to null as well)."""
    own = Window.partitionBy("src")
    place = F.row_number().over(own.orderBy("dst")) - 1
    e = edges.select("src", "dst", F.count("*").over(own).alias("d"), F.floor(place / LIST_EDGES).alias("piece"))
    return e.groupBy("src", "d", "piece").agg(F.collect_list("dst").alias("dsts")).drop("piece")


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-6, restart: Column | None = None) -> DataFrame:
    """(id, rank). Dangling mass is not handed out again. restart: share of the restart for each vertex (default: alike).

    Edges are read once, into lists by their source; a round brings lists and ranks together and sends sums of shares on.
    """
    own = _cut(vertices.select("id", *([] if restart is None else [restart.cast("double").alias("base")])))
    alike = F.lit(1.0 / max(own.count(), 1))
    state = own.select("id", alike.alias("base") if restart is None else "base", alike.alias("rank"))
    links = _cut(_lists(edges))
    for _ in range(iterations):
        shares = links.join(state.select(F.col("id").alias("src"), "rank"), "src").select(F.explode("dsts").alias("id"), (F.col("rank") / F.col("d")).alias("s"))
        sent = shares.groupBy("id").agg(F.sum("s").alias("s"))
        rank = F.lit(1 - damping) * F.col("base") + F.lit(damping) * F.coalesce("s", F.lit(0.0))
        state = _cut(state.join(sent, "id", "left").select("id", "base", rank.alias("rank"), F.col("rank").alias("old")))
        moved = state.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        if moved is None or moved < tolerance:
            break
    return state.select("id", "rank")


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest vertex that edges reach in either direction.

    A round passes the smallest label along edges, lets each label's vertex take it as well (so whole trees
    move at once), and halves the way to the smallest by following labels; long chains take few rounds.
    """
    both = _cut(undirected(edges))
    label = _cut(vertices.select("id", F.col("id").alias("component")))
    while True:
        near = both.join(label.select(F.col("id").alias("dst"), F.col("component").alias("c")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("c").alias("c"))
        hooked = label.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("c", "component")).alias("component"))
        roots = hooked.groupBy(F.col("old").alias("id")).agg(F.min("component").alias("new"))
        step = _cut(hooked.join(roots, "id", "left").select("id", "old", F.least("component", F.coalesce("new", "component")).alias("component")))
        # labels that point on are few; without the rows that stand for themselves no label is a hot key
        up = step.select("component").distinct().join(step.where("id <> component").select(F.col("id").alias("component"), F.col("component").alias("u")), "component")
        new = _cut(step.join(up, "component", "left").select("id", "old", F.least("component", F.coalesce("u", "component")).alias("component")))
        changed = not new.where("component <> old").isEmpty()
        label = new.select("id", "component")
        if not changed:
            return label


def _integral(df: DataFrame, *columns: str) -> bool:
    return all(isinstance(df.schema[c].dataType, IntegralType) for c in columns)


def _numbers(*ends: DataFrame) -> DataFrame:
    """(id, n): a number for each id."""
    ids = ends[0]
    for e in ends[1:]:
        ids = ids.union(e)
    return _cut(ids.toDF("id").where("id IS NOT NULL").distinct().withColumn("n", F.monotonically_increasing_id()))


def _numbered(df: DataFrame, numbers: DataFrame, columns: Sequence[str], back: bool = False) -> DataFrame:
    """df with numbers for ids in some columns, or ids for numbers."""
    old, new = ("n", "id") if back else ("id", "n")
    for c in columns:
        df = df.withColumnRenamed(c, "_c").join(numbers.select(F.col(old).alias("_c"), F.col(new).alias(c)), "_c").drop("_c")
    return df


def _upward(edges: DataFrame) -> DataFrame:
    """Edges as (x, w), from the smaller id; repeated ones count once where lists are made of them."""
    return edges.where("src <> dst").select(F.least("src", "dst").cast("long").alias("x"), F.greatest("src", "dst").cast("long").alias("w"))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) with a < b < c, each two joined by an edge of either direction.

    Lists of neighbours of larger id are intersected in blocks of vertices, the shorter one gone through, so hubs cost little.
    """
    if not _integral(edges, "src", "dst"):
        n = _numbers(edges.select("src"), edges.select("dst"))
        t = _numbered(triangles(_numbered(edges.select("src", "dst"), n, ["src", "dst"])), n, ["a", "b", "c"], back=True)
        t = t.select(F.array_sort(F.array("a", "b", "c")).alias("t"))
        return t.select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))
    kind = edges.select(F.least("src", "dst").alias("k")).schema["k"].dataType
    return meetings(_upward(edges), None, "triples").select(F.col("x").cast(kind).alias("a"), F.col("y").cast(kind).alias("b"), F.col("z").cast(kind).alias("c"))


def clustering(edges: DataFrame) -> DataFrame:
    """(id, coefficient): triangles through a vertex over pairs of its neighbours."""
    if not _integral(edges, "src", "dst"):
        n = _numbers(edges.select("src"), edges.select("dst"))
        return _numbered(clustering(_numbered(edges.select("src", "dst"), n, ["src", "dst"])), n, ["id"], back=True).select("id", "coefficient")
    kind = edges.select(F.least("src", "dst").alias("k")).schema["k"].dataType
    per = meetings(_upward(edges), None, "vertices").groupBy("id").agg(F.sum("triples").alias("t"), F.sum("edges").alias("d"))
    return per.select(F.col("id").cast(kind).alias("id"), F.when(F.col("d") > 1, 2 * F.col("t") / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("coefficient"))


def similarity(edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """pairs (a, b), each once, with common, jaccard and cosine of their outgoing neighbours; 0 where either has none. Without pairs, those of edges; ids are not null."""
    if not _integral(edges, "src", "dst") or pairs is not None and not _integral(pairs, "a", "b"):
        ends = [edges.select("src"), edges.select("dst")] + ([] if pairs is None else [pairs.select("a"), pairs.select("b")])
        n = _numbers(*ends)
        x = similarity(_numbered(edges.select("src", "dst"), n, ["src", "dst"]), None if pairs is None else _numbered(pairs.select("a", "b"), n, ["a", "b"]))
        return _numbered(x, n, ["a", "b"], back=True).select("a", "b", "common", "jaccard", "cosine")
    kinds = (edges.schema["src"].dataType, edges.schema["dst"].dataType) if pairs is None else (pairs.schema["a"].dataType, pairs.schema["b"].dataType)
    two = None if pairs is None else pairs.select(F.col("a").cast("long").alias("x"), F.col("b").cast("long").alias("w"))
    x = meetings(edges.select(F.col("src").cast("long").alias("x"), F.col("dst").cast("long").alias("w")), two, "pairs")
    union, both = F.col("nx") + F.col("ny") - F.col("common"), F.sqrt(F.col("nx").cast("double") * F.col("ny"))
    return x.select(F.col("x").cast(kinds[0]).alias("a"), F.col("y").cast(kinds[1]).alias("b"), "common", F.when(union > 0, F.col("common") / union).otherwise(0.0).alias("jaccard"), F.when(both > 0, F.col("common") / both).otherwise(0.0).alias("cosine"))


#: Vertices of more neighbours than this are not compared with others.
TWIN_DEGREE = 64
#: Ids of one class that are paired in one row.
CLASS_CHUNK = 1024


def _classes(edges: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, rep, own), edges of representatives): vertices with the same neighbours in both directions are one class.

    Twins are equally far from and to all others, and no shortest path goes from a vertex through its twin;
    own tells the given vertices from those that only edges name.
    """
    e = _cut(edges.select("src", "dst").where("src <> dst").distinct())
    sides = e.select(F.col("src").alias("id"), F.struct(F.lit(0).alias("side"), F.col("dst").alias("other")).alias("k")).union(e.select("dst", F.struct(F.lit(1).alias("side"), F.col("src").alias("other"))))
    few = sides.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") <= TWIN_DEGREE).select("id")
    keys = sides.join(few, "id").groupBy("id").agg(F.sort_array(F.collect_list("k")).alias("k"))
    same = keys.join(keys.groupBy("k").agg(F.min("id").alias("rep")), "k").select("id", "rep")
    ends = e.select("src", F.lit(False)).union(e.select("dst", F.lit(False)))
    known = vertices.select("id", F.lit(True).alias("own")).union(ends).groupBy("id").agg(F.max("own").alias("own"))
    of = _cut(known.join(same, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"), "own"))
    first = of.where("id = rep").select("id")
    return of, _cut(e.join(first.withColumnRenamed("id", "src"), "src", "left_semi").join(first.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))


def _class_distances(edges: DataFrame, sources: DataFrame, depth: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, edges of representatives, distances): (source, id, twin, distance, n, k) of classes.

    twin rows lead from a vertex to its twins, n counts the vertices reached and k the sources that reach them.
    """
    of, e = _classes(edges, sources)
    size = _cut(of.groupBy("rep").agg(F.count("*").alias("n"), F.count_if("own").alias("k")))
    d = _paths(e, size.where("k > 0").select(F.col("rep").alias("id")), depth)
    # to a twin: the shortest way round
    back = d.where("source <> id").join(e.select(F.col("src").alias("id"), F.col("dst").alias("source")), ["source", "id"]).groupBy("source").agg((F.min("distance") + 1).alias("distance"))
    back = back.where(F.lit(True) if depth is None else F.col("distance") <= depth)
    every = d.withColumn("twin", F.lit(False)).unionByName(back.select("source", F.col("source").alias("id"), F.lit(True).alias("twin"), "distance"))
    every = every.join(size.select(F.col("rep").alias("source"), "k"), "source").join(size.select(F.col("rep").alias("id"), "n"), "id")
    n = F.when(F.col("twin"), F.col("n") - 1).when(F.col("source") == F.col("id"), 1).otherwise(F.col("n"))
    return of, e, _cut(every.select("source", "id", "twin", "distance", n.alias("n"), "k").where("n > 0"))


def _paths(edges: DataFrame, sources: DataFrame, depth: int | None = None, weight: str | None = None) -> DataFrame:
    """(source, id, distance), source by source: breadth first, or cheapest with a weight."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = _cut(edges.select("src", "dst", w.alias("w")))
    best = _cut(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("distance")))
    front = best
    if depth is None:  # a cheapest path repeats no vertex
        depth = e.select("dst").distinct().count() + 1
    for _ in range(depth):
        step = front.join(e.withColumnRenamed("src", "id"), "id").select("source", F.col("dst").alias("id"), (F.col("distance") + F.col("w")).alias("distance"))
        step = step.groupBy("source", "id").agg(F.min("distance").alias("distance"))
        old = best.withColumnRenamed("distance", "old")
        front = _cut(step.join(old, ["source", "id"], "left").where("old IS NULL OR distance < old").select("source", "id", "distance"))
        if front.isEmpty():
            break
        best = _cut(best.join(front.select("source", "id"), ["source", "id"], "left_anti").union(front))
    return best


def distances(edges: DataFrame, sources: DataFrame, depth: int | None = None, weight: str | None = None) -> DataFrame:
    """(source, id, distance) of all that each source (id) reaches, or within so many steps: breadth first, or cheapest with a weight.

    Without a weight, classes of twins are searched and their members paired last, in rows that are never shuffled.
    """
    if weight:
        return _paths(edges, sources, depth, weight)
    of, _, d = _class_distances(edges, sources, depth)
    part = F.floor(F.row_number().over(Window.partitionBy("rep").orderBy("id")) / CLASS_CHUNK)
    packed = lambda members: members.withColumn("part", part).groupBy("rep", "part").agg(F.collect_list("id").alias("ids"))
    own = packed(of.where("own")).select(F.col("rep").alias("source"), F.col("ids").alias("sources"))
    pairs = d.where("source <> id OR twin").select("source", "id", "distance").join(own, "source").join(packed(of).select(F.col("rep").alias("id"), "ids"), "id")
    pairs = pairs.select("sources", "ids", "distance").repartition(4 * edges.sparkSession.sparkContext.defaultParallelism)
    pairs = pairs.select(F.explode("sources").alias("source"), "ids", "distance").select("source", F.explode("ids").alias("id"), "distance").where("source <> id")
    return of.where("own").select(F.col("id").alias("source"), "id", F.lit(0.0).alias("distance")).union(pairs)


def closeness(vertices: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, closeness): reached vertices over the sum of their distances; twins have the same."""
    of, _, d = _class_distances(edges, vertices, depth)
    sums = d.where("distance > 0").groupBy(F.col("source").alias("rep")).agg((F.sum("n") / F.sum(F.col("distance") * F.col("n"))).alias("closeness"))
    return vertices.select("id").join(of.join(sums, "rep").select("id", "closeness"), "id", "left").fillna(0.0, ["closeness"])


def betweenness(vertices: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, betweenness): shares of the shortest paths through a vertex, by counting paths outwards and dependencies back.

    Classes of twins stand for their members: paths through a class count once for each member.
    """
    of, e, d = _class_distances(edges, vertices, depth)
    # edges on shortest paths: one step farther from the source; no path goes on from a twin of it
    near = d.where("NOT twin").select("source", F.col("id").alias("src"), F.col("distance").alias("x"), F.col("n").alias("m"))
    step = near.join(e, "src").join(d.select("source", F.col("id").alias("dst"), "twin", F.col("distance").alias("y"), "n"), ["source", "dst"]).where("y = x + 1")
    step = _cut(step.select("source", "src", "dst", "twin", "y", "m", "n"))
    top = int(d.agg(F.coalesce(F.max("distance"), F.lit(0.0))).first()[0])
    paths = d.where("distance = 0").select("source", "id", "twin", F.lit(1.0).alias("sigma"))
    for level in range(1, top + 1):
        new = step.where(F.col("y") == level).join(paths.where("NOT twin").select("source", F.col("id").alias("src"), "sigma"), ["source", "src"]).groupBy("source", F.col("dst").alias("id"), "twin").agg(F.sum(F.col("sigma") * F.col("m")).alias("sigma"))
        paths = _cut(paths.union(new))
    dep = d.select("source", "id", "twin", F.lit(0.0).alias("delta"))
    for level in range(top, 0, -1):
        share = step.where(F.col("y") == level).join(paths.where("NOT twin").select("source", F.col("id").alias("src"), F.col("sigma").alias("s1")), ["source", "src"])
        share = share.join(paths.select("source", F.col("id").alias("dst"), "twin", F.col("sigma").alias("s2")), ["source", "dst", "twin"]).join(dep.select("source", F.col("id").alias("dst"), "twin", "delta"), ["source", "dst", "twin"])
        add = share.groupBy("source", F.col("src").alias("id"), F.lit(False).alias("twin")).agg(F.sum(F.col("s1") / F.col("s2") * (1 + F.col("delta")) * F.col("n")).alias("add"))
        dep = _cut(dep.join(add, ["source", "id", "twin"], "left").select("source", "id", "twin", (F.col("delta") + F.coalesce("add", F.lit(0.0))).alias("delta")))
    sources = d.where("distance = 0").select("source", "k")
    total = dep.where("source <> id").join(sources, "source").groupBy(F.col("id").alias("rep")).agg(F.sum(F.col("delta") * F.col("k")).alias("betweenness"))
    return vertices.select("id").join(of.join(total, "rep").select("id", "betweenness"), "id", "left").fillna(0.0, ["betweenness"])


def simple_paths(edges: DataFrame, start, end, longest: int, weight: str | None = None) -> DataFrame:
    """(path, cost) of all paths without repeated vertices, of at most so many edges."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = edges.select("src", "dst", w.alias("w"))
    front = e.where(F.col("src") == start).select(F.array("src", "dst").alias("path"), F.col("dst").alias("at"), F.col("w").alias("cost")).where(F.size(F.array_distinct("path")) == 2)
    found = front.where(F.col("at") == end)
    for _ in range(longest - 1):
        front = front.where(F.col("at") != end).join(e, F.col("at") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        front = _cut(front.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"), (F.col("cost") + F.col("w")).alias("cost")))
        found = found.union(front.where(F.col("at") == end))
    return found.select("path", "cost")


def k_shortest_paths(edges: DataFrame, start, end, k: int, longest: int | None = None, weight: str | None = None, batch: int = 1000) -> DataFrame:
    """(path, cost) of the k cheapest paths without repeated vertices, of any length unless longest is given.

    Weights are not negative. Paths grow in the order of their cost and the least that is left to the end,
    so many at a time, until no open path can be among the k cheapest.
    """
    if longest is not None:
        return simple_paths(edges, start, end, longest, weight).orderBy("cost", "path").limit(k)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = edges.select("src", "dst", w.alias("w")).where("src <> dst")
    last = e.where(F.col("dst") == end).select(F.col("dst").alias("id")).distinct()
    left = distances(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"), last, None, "w").select(F.col("id").alias("dst"), F.col("distance").alias("left"))
    e = _cut(e.join(left, "dst"))
    found = e.limit(0).select(F.array("src", "dst").alias("path"), F.col("w").alias("cost"))
    if start == end:
        return found
    waiting = _cut(e.where(F.col("src") == start).select(F.array("src", "dst").alias("path"), F.col("dst").alias("at"), F.col("w").alias("cost"), (F.col("w") + F.col("left")).alias("least")))
    while True:
        found = _cut(found.union(waiting.where(F.col("at") == end).select("path", "cost")).orderBy("cost", "path").limit(k))
        waiting = waiting.where(F.col("at") != end)
        n, worst = found.agg(F.count("*"), F.max("cost")).first()
        if n == k:  # equally cheap paths go on; sums in another order differ a little
            waiting = waiting.where(F.col("least") <= worst + 1e-9 * abs(worst))
        # equal rows, from parallel edges, go together
        chosen = waiting.select("path", "cost", "least").distinct().orderBy("least", "path").limit(batch)
        first = _cut(waiting.join(chosen.select("path", "cost"), ["path", "cost"], "left_semi"))
        if first.isEmpty():
            return found.orderBy("cost", "path")
        more = first.join(e, F.col("at") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        more = more.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"), (F.col("cost") + F.col("w")).alias("cost"), (F.col("cost") + F.col("w") + F.col("left")).alias("least"))
        waiting = _cut(waiting.join(first.select("path", "cost"), ["path", "cost"], "left_anti").select("path", "at", "cost", "least").union(more))


def label_communities(vertices: DataFrame, edges: DataFrame, iterations: int = 10) -> DataFrame:
    """(id, community): each vertex takes the most frequent label around it (the smallest of equals)."""
    both = _cut(undirected(edges))
    label = _cut(vertices.select("id", F.col("id").alias("community")))
    for _ in range(iterations):
        votes = both.join(label.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("id").agg(F.max_by("community", F.struct("n", -F.col("community"))).alias("new"))
        new = _cut(label.join(best, "id", "left").select("id", F.coalesce("new", "community").alias("community")))
        changed = new.join(label.withColumnRenamed("community", "old"), "id").where("community <> old").limit(1).count()
        label = new
        if not changed:
            break
    return label


def modularity(edges: DataFrame, community: DataFrame) -> DataFrame:
    """(q): how many more edges are within communities than by chance."""
    e = undirected(edges)
    x = e.join(community.select(F.col("id").alias("src"), F.col("community").alias("cs")), "src").join(community.select(F.col("id").alias("dst"), F.col("community").alias("cd")), "dst")
    per = x.groupBy(F.col("cs").alias("c")).agg(F.sum((F.col("cs") == F.col("cd")).cast("double")).alias("inside"), F.count("*").cast("double").alias("ends"))
    total = per.agg(F.sum("ends").alias("m2"))
    return per.crossJoin(F.broadcast(total)).agg(F.sum(F.col("inside") / F.col("m2") - F.pow(F.col("ends") / F.col("m2"), F.lit(2.0))).alias("q"))


def _moved(links: DataFrame, passes: int) -> DataFrame:
    """(id, community) of a weighted graph (src, dst, w; both directions, loops once): vertices move to the neighbouring community of greatest gain."""
    d = _cut(links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d")))
    m2 = float(d.agg(F.sum("d")).first()[0] or 1.0)

    def quality(label: DataFrame) -> float:
        x = links.join(label.select(F.col("id").alias("src"), F.col("community").alias("cs")), "src").join(label.select(F.col("id").alias("dst"), F.col("community").alias("cd")), "dst")
        per = x.groupBy("cs").agg(F.sum(F.when(F.col("cs") == F.col("cd"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("ends"))
        return float(per.agg(F.sum(F.col("inside") / m2 - F.pow(F.col("ends") / m2, F.lit(2.0)))).first()[0] or 0.0)

    label = _cut(d.select("id", F.col("id").alias("community")))
    best, best_q, stale = label, quality(label), 0
    for n in range(passes):
        size = label.join(d, "id").groupBy("community").agg(F.sum("d").alias("tot"))
        near = links.where("src <> dst").join(label.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("w").alias("k"))
        # staying is a choice as well
        near = near.union(label.select("id", "community", F.lit(0.0).alias("k"))).groupBy("id", "community").agg(F.sum("k").alias("k"))
        x = near.join(size, "community").join(d, "id").join(label.withColumnRenamed("community", "own"), "id")
        rest = F.col("tot") - F.when(F.col("community") == F.col("own"), F.col("d")).otherwise(0.0)
        gain = F.round(F.col("k") - rest * F.col("d") / F.lit(m2), 9)
        move = x.groupBy("id").agg(F.max_by("community", F.struct(gain, -F.col("community"))).alias("new"))
        # every other vertex, by a hash that changes, moves at once
        turn = F.pmod(F.xxhash64("id", F.lit(n)), F.lit(2)) == 0
        label = _cut(label.join(move, "id").select("id", F.when(turn, F.col("new")).otherwise(F.col("community")).alias("community")))
        q = quality(label)
        best, best_q, stale = (label, q, 0) if q > best_q + 1e-9 else (best, best_q, stale + 1)
        if stale == 2:
            break
    return best


def louvain(vertices: DataFrame, edges: DataFrame, passes: int = 6, levels: int = 6) -> DataFrame:
    """(id, community): communities of greatest modularity gain, level by level.

    At a level vertices move (in a pass half of them at once, so the best of all passes is kept); then each
    community becomes a vertex, its inner edges a loop, and the next level moves these, until none moves.
    """
    links = _cut(undirected(edges).withColumn("w", F.lit(1.0)))
    label = _cut(vertices.select("id", F.col("id").alias("community")))
    for _ in range(levels):
        if links.isEmpty():
            break
        step = _moved(links, passes)
        if step.where("id <> community").isEmpty():
            break
        own = step.select(F.col("id").alias("community"), F.col("community").alias("up"))
        label = _cut(label.join(own, "community", "left").select("id", F.coalesce("up", "community").alias("community")))
        ends = links.join(step.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(step.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
        links = _cut(ends.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
    return label


def influence(edges: DataFrame, k: int, rounds: int = 2) -> list:
    """k vertices whose rounds-step reach adds most to what is covered, greedily (of equals the smallest).

    Members of a class of twins reach the same, so classes are counted, and of each class the first member
    that is not covered and the first of all are the only ones to choose from.
    """
    of, _, d = _class_distances(edges, edges.select(F.col("src").alias("id")).distinct(), rounds)
    whole = _cut(d.where("source <> id OR twin").select("source", "id").union(of.where("own").groupBy("rep").agg(F.count("*").alias("n")).join(of.groupBy("rep").agg(F.count("*").alias("n")), ["rep", "n"]).where("n = 1").select("rep", "rep")).distinct())
    chosen: list = []
    covered = whole.limit(0).select("id")
    for _ in range(k):
        # vertices that are not covered yet; a chosen one covers itself even where its twins are out of reach
        left = of.join(covered.withColumnRenamed("id", "rep"), "rep", "left_anti").where(~F.col("id").isin(chosen) if chosen else F.lit(True))
        n = left.groupBy(F.col("rep").alias("id")).agg(F.count("*").alias("n"))
        gain = whole.join(n, "id").groupBy(F.col("source").alias("rep")).agg(F.sum("n").alias("n"))
        inner = whole.where("source = id").select(F.col("source").alias("rep"), F.lit(0).alias("one"))
        first = left.where("own").groupBy("rep").agg(F.min("id").alias("id")).withColumn("more", F.lit(1)).union(of.where("own").groupBy("rep").agg(F.min("id").alias("id")).withColumn("more", F.lit(0)))
        best = first.join(gain, "rep", "left").join(inner, "rep", "left").select("rep", "id", (F.coalesce("n", F.lit(0)) + F.col("more") * F.coalesce("one", F.lit(1))).alias("n"))
        top = best.where("n > 0").orderBy(F.desc("n"), "id").first()
        if top is None:
            break
        chosen.append(top["id"])
        covered = _cut(covered.union(whole.where(F.col("source") == top["rep"]).select("id")).distinct())
    return chosen


def recommend(edges: DataFrame, user, k: int) -> DataFrame:
    """(id, score): what those who share most with a user have and the user hasn't."""
    own = edges.where(F.col("src") == user).select("dst").distinct()
    alike = edges.join(own, "dst").where(F.col("src") != user).groupBy("src").agg(F.countDistinct("dst").alias("w"))
    return edges.select("src", "dst").distinct().join(alike, "src").join(own, "dst", "left_anti").groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def random_walk(vertices: DataFrame, edges: DataFrame, start, damping: float = 0.85, iterations: int = 30) -> DataFrame:
    """Ranks of a walk that starts again at one vertex."""
    return pagerank(vertices, edges, damping, iterations, 1e-9, F.when(F.col("id") == start, 1.0).otherwise(0.0))


def snapshot(edges: DataFrame, ts: str, at: Column) -> DataFrame:
    return edges.where(F.col(ts) <= at)


def embedding(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, features): degree, rank and clustering of each vertex."""
    r = pagerank(vertices, edges, iterations=10)
    x = vertices.select("id").join(degrees(edges), "id", "left").join(r, "id", "left").join(clustering(edges), "id", "left")
    return x.select("id", F.array(F.coalesce(F.col("degree").cast("double"), F.lit(0.0)), F.coalesce("rank", F.lit(0.0)), F.coalesce("coefficient", F.lit(0.0))).alias("features"))


def lineage(edges: DataFrame, start, depth: int, backward: bool = False) -> DataFrame:
    """(id, distance) of what lies downstream (or upstream) of a node."""
    e = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if backward else edges.select("src", "dst")
    one = e.sparkSession.range(1).select(F.lit(start).cast(edges.schema["src"].dataType).alias("id"))
    return _paths(e, one, depth).where("distance > 0").select("id", F.col("distance").cast("int").alias("distance"))

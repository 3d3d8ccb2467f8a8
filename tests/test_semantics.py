"""Choices among differing semantics, on small literal tables."""

import pytest
from pyspark.sql import functions as F

from skeinql.functions.scalars import SCALAR_FUNCTIONS
from skeinql.functions.strings import call, stem
from skeinql.operators import approximate, cep, documents, graph, joins, planar, quality, spatial, temporal, textsearch, windows
from skeinql.plans.builder import Query, plan_report, pushed_filters
from skeinql.plans.catalog import Catalog, ConstraintError
from skeinql.plans.materialized import RefreshPolicy, ResultCache, ViewStore
from skeinql.plans.procedures import Cursor, CursorError, Package, forall


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(columns)]).first())


def test_strings(spark):
    lit = F.lit
    assert one(spark, call("LEN", lit("ab  ")), call("DATALENGTH", lit("é")), call("CHARINDEX", "b", lit("abab"), 3)) == (2, 2, 4)
    assert one(spark, call("STUFF", lit("abcdef"), 2, 3, "XY"), call("SUBSTRING", lit("abc"), 0, 2), call("QUOTENAME", lit("a]b"))) == ("aXYef", "", "[a]]b]")
    assert one(spark, call("STR", lit(3.14159), 6, 2), call("PATINDEX", "%b_d%", lit("abcd")), call("PATINDEX", "b%", lit("abcd"))) == ("  3.14", 2, 0)
    assert one(spark, call("DIFFERENCE", lit("Robert"), lit("Rupert")), stem(lit("walking")), stem(lit("class")), stem(lit("cars"))) == (4, "walk", "class", "car")
    assert one(spark, call("CONCAT", lit("a"), None, lit("b")), call("NCHAR", lit(8364)), call("REPLICATE", lit("ab"), lit(2))) == ("ab", "€", "abab")
    with pytest.raises(ValueError):
        call("NO_SUCH", lit(1))


def test_soundex_and_hashes(spark):
    import xxhash

    code = lambda x: call("SOUNDEX", F.lit(x))
    assert one(spark, *map(code, ["Robert", "Tymczak", "Ashcraft", "", "123", "a"])) == ("R163", "T522", "A226", "0000", "0000", "A000")  # H separates equal codes here
    assert one(spark, call("XXHASH64", F.lit("abc")))[0] == xxhash.xxh64_intdigest("abc", 42) - (1 << 64) * (xxhash.xxh64_intdigest("abc", 42) >> 63)


def test_scalars(spark):
    f = SCALAR_FUNCTIONS
    assert one(spark, f["TRUNC"](F.lit(-2.57), 1), f["ROUND"](F.lit(2.5)), f["DECODE"](F.lit(None).cast("int"), None, "null", 1, "one", "other"), f["NVL2"](F.lit(None), 1, 2)) == (-2.5, 3.0, "null", 2)
    with pytest.raises(Exception, match="SQRT"):
        one(spark, f["SQRT"](F.lit(-1.0)))
    with pytest.raises(Exception, match="MOD"):
        one(spark, f["MOD"](F.lit(1), F.lit(0)))


def test_joins(spark):
    left = spark.createDataFrame([("a", 10), ("a", 20), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 15, "y"), ("a", 20, "z")], "k string, t int, v string")
    got = joins.asof_join(left, right, ["k"], "t", "t", ["v"]).orderBy("k", "t").collect()
    assert [r.v for r in got] == ["x", "z", None]
    hot = spark.range(100).select((F.col("id") * 0).alias("k"), "id")
    assert joins.salted_join(hot, spark.createDataFrame([(0, "v")], "k long, v string"), "k", 4).count() == 100
    assert joins.lookup(left, right.select("k", "v"), "k", "k", "vs").where("k = 'b'").first().vs == []


def test_window_exclusion(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (1, "b", 4.0)], "p int, o string, v double")
    got = df.select(windows.sum_excluding("v", ["p"], ["o"], "current row").alias("c"), windows.sum_excluding("v", ["p"], ["o"], "group").alias("g"), windows.sum_excluding("v", ["p"], ["o"], "ties").alias("t")).collect()
    assert sorted(map(tuple, got)) == [(3.0, 3.0, 7.0), (5.0, 4.0, 6.0), (6.0, 4.0, 5.0)]


def test_json_paths():
    doc = {"store": {"book": [{"p": 8, "t": "a"}, {"p": 12, "t": "b"}, {"t": "c"}]}, "x": [1, 2, 3, 4]}
    walk = lambda p: documents.walk(doc, documents.parse_path(p))
    assert walk("$.store.book[*].t") == ["a", "b", "c"]
    assert walk("$..p") == [8, 12] and walk("$.x[1:3]") == [2, 3] and walk("$.x[-1]") == [4] and walk("$.x[0,2]") == [1, 3]
    assert walk("$.store.book[?(@.p > 10)].t") == ["b"] and walk("$.store.book[?(@.p && @.p < 10)].t") == ["a"]
    assert walk("$.store.book[?(!(@.p))].t") == ["c"] and walk("$.store.book[?(@.t =~ /^[ab]$/)].p") == [8, 12]
    assert documents.merge_patch({"a": 1, "b": {"c": 2}}, {"a": None, "b": {"d": 3}}) == {"b": {"c": 2, "d": 3}}
    with pytest.raises(ValueError):
        documents.parse_path("store")


def test_query_by_example(spark):
    rows = [(1, '{"a": 5, "tags": ["x", "y"], "n": null}'), (2, '{"a": "5", "tags": []}'), (3, "{bad")]
    df = spark.createDataFrame(rows, "id int, doc string")
    ids = lambda q: [r.id for r in df.where(documents.matches(F.col("doc"), q)).orderBy("id").collect()]
    assert ids({"a": 5}) == [1] and ids({"a": {"$ne": 5}}) == [2, 3] and ids({"n": {"$exists": False}}) == [1, 2, 3]
    assert ids({"tags": {"$size": 2}}) == [1] and ids({"tags": {"$all": ["x"]}}) == [1] and ids({"a": {"$type": "string"}}) == [2]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5)], "src long, dst long")
    v = spark.range(1, 7)
    assert {tuple(r) for r in graph.components(v, e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)}
    assert [tuple(r) for r in graph.triangles(e).collect()] == [(1, 2, 3)]
    between = {r.id: r.betweenness for r in graph.betweenness(spark.range(1, 4), spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")).collect()}
    assert between == {1: 0.0, 2: 1.0, 3: 0.0}
    assert graph.pagerank(v, e, iterations=3).count() == 6


def test_pagerank_reads_edges_once(spark, monkeypatch):
    """Also lists in pieces, repeated edges, edges to null, from unknown vertices and to vertices that repeat."""
    rows = [(1, 2), (1, 2), (1, 3), (2, 3), (3, 1), (3, None), (9, 1), (4, 9)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    monkeypatch.setattr(graph, "LIST_EDGES", 1, raising=False)
    e = spark.createDataFrame(rows, "src long, dst long").mapInArrow(counted, "src long, dst long")
    got = {r.id: r.rank for r in graph.pagerank(spark.range(1, 6), e, iterations=3, tolerance=0.0).collect()}
    rank = dict.fromkeys(range(1, 6), 0.2)
    for _ in range(3):
        rank = {v: 0.15 * 0.2 + 0.85 * sum(rank.get(s, 0) / sum(a == s for a, _ in rows) for s, t in rows if t == v) for v in rank}
    assert got == pytest.approx(rank) and seen.value == len(rows)


def test_geometry():
    square = spatial.parse_wkt("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))")
    assert spatial.area(*square) == 15 and planar.contains(square, ("POINT", [3, 3])) and not planar.contains(square, ("POINT", [1.5, 1.5]))
    for text in ("POINT (1 2)", "MULTIPOINT (1 2, 3 4)", "LINESTRING (0 0, 1 1)", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))", "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1))"):
        geometry = spatial.parse_wkt(text)
        assert spatial.to_wkt(*geometry) == text and spatial.parse_wkb(spatial.to_wkb(*geometry)) == geometry
    assert planar.distance(("POINT", [0, 0]), ("LINESTRING", [[3, -1], [3, 1]])) == 3
    touching = spatial.parse_wkt("POLYGON ((4 0, 8 0, 8 4, 4 4, 4 0))")
    assert planar.touches(square, touching) and not planar.overlaps(square, touching)
    assert planar.simplify("LINESTRING", [[0, 0], [1, 0.01], [2, 0]], 0.1)[1] == [[0, 0], [2, 0]]
    assert abs(spatial.vincenty(50.06632, -5.71475, 58.64402, -3.07009) - 969954.2) < 1
    assert spatial.shortest_route([("a", "b", 1), ("b", "c", 1), ("a", "c", 5)], "a", "c") == (2, ["a", "b", "c"])
    assert len(spatial.tour([(0, 0), (1, 0), (1, 1), (0, 1)])) == 4


def test_patterns(spark):
    rows = [("u", i, c) for i, c in enumerate("abbcaxc")]
    df = spark.createDataFrame(rows, "k string, i int, c string").withColumn("t", F.timestamp_seconds("i"))
    steps = [cep.Step("a", F.col("c") == "a"), cep.Step("b", F.col("c") == "b", "+"), cep.Step("c", F.col("c") == "c")]
    assert [r.events for r in cep.match(df, ["k"], "t", steps).collect()] == [4]
    two = cep.followed_by(cep.Step("a", F.col("c") == "a"), cep.Step("c", F.col("c") == "c"))
    assert cep.match(df, ["k"], "t", two).count() == 2 and cep.match(df, ["k"], "t", two, within_seconds=2).count() == 1


def test_patterns_within_time_and_overlapping_conditions(spark):
    six = spark.createDataFrame([("u", 10 * i, "A") for i in range(6)], "k string, i int, c string").withColumn("t", F.timestamp_seconds("i"))
    runs = cep.match(six, ["k"], "t", [cep.Step("a", F.col("c") == "A", "+")], within_seconds=20).collect()
    assert [r.events for r in sorted(runs, key=lambda r: r.start)] == [3, 3]
    both = spark.createDataFrame([("u", 0, 5), ("u", 1, 7)], "k string, i int, v int").withColumn("t", F.timestamp_seconds("i"))
    odd, large = cep.Step("odd", F.col("v") % 2 == 1), cep.Step("large", F.col("v") > 6)
    assert cep.match(both, ["k"], "t", [odd, large]).count() == 1  # 7 meets both conditions
    tied = spark.createDataFrame([("u", 2, "b"), ("u", 1, "a")], "k string, n int, c string").withColumn("t", F.timestamp_seconds(F.lit(0)))
    pair = [cep.Step("a", F.col("c") == "a"), cep.Step("b", F.col("c") == "b")]
    assert cep.match(tied, ["k"], "t", pair, tie=["n"]).count() == 1 and cep.match(tied.withColumn("n", -F.col("n")), ["k"], "t", pair, tie=["n"]).count() == 0
    no = cep.Step("no", F.col("c") == "A", negated=True)
    assert cep.match(six.withColumn("c", F.when(F.col("i") == 30, "B").otherwise(F.col("c"))), ["k"], "t", [no]).count() == 1


def test_pattern_queries_against_plain_loops(spark):
    """The registered pattern queries, event by event."""
    from skeinql import queries as engine

    folder = "/root/testdata/sf0.001"
    by = {}
    for r in sorted(spark.read.parquet(f"{folder}/events.parquet").collect(), key=lambda r: (r.user_id, r.ts, r.event_id)):
        by.setdefault(r.user_id, []).append(r)
    pattern, followed = [], []
    for user, own in by.items():
        at = 0
        while at < len(own):
            end = at + 1
            if own[at].event_type == "view":
                while end < len(own) and own[end].event_type == "click" and (own[end].ts - own[at].ts).total_seconds() <= 3 * 86400:
                    end += 1
                if end > at + 1 and end < len(own) and own[end].event_type == "purchase" and (own[end].ts - own[at].ts).total_seconds() <= 3 * 86400:
                    pattern.append((user, own[at].ts, own[end].ts, end - at + 1, round(sum(r.value for r in own[at : end + 1]), 6)))
                    at = end + 1
                    continue
            at += 1
        at = 0
        while at < len(own):
            later = next((k for k in range(at + 1, len(own)) if own[k].event_type == "purchase"), None) if own[at].event_type == "signup" else None
            if later is not None and (own[later].ts - own[at].ts).total_seconds() <= 86400:
                followed.append((user, own[at].ts, own[later].ts))
                at = later
            at += 1
    got = engine.queries()
    assert sorted(pattern) == sorted((r.user_id, r.start, r.end, r.events, round(r.total, 6)) for r in got["cep_pattern"](spark, folder).collect())
    assert sorted(followed) == sorted((r.user_id, r.start, r.end) for r in got["cep_followed_by"](spark, folder).collect())


def test_pattern_skips_and_gaps(spark):
    df = spark.createDataFrame([("u", t, "A") for t in (0, 1, 2, 10, 11)], "k string, i int, c string").withColumn("t", F.timestamp_seconds("i"))
    run = cep.Step("a", F.col("c") == "A", "+")
    sizes = lambda **how: [r.events for r in sorted(cep.match(df, ["k"], "t", [run], value="i", **how).collect(), key=lambda r: r.start)]
    assert sizes(each_seconds=2) == [3, 2] and sizes(each_seconds=2, skip="to_next") == [3, 2, 1, 2, 1] and sizes(each_seconds=2, skip="no_prefix") == [3, 2]
    assert sizes(each_seconds=2, skip="to_last") == [3, 1, 2, 1]
    first = cep.match(df, ["k"], "t", [run], value="i", each_seconds=2).orderBy("start").first()
    assert (first.total, first.mean, first.least, first.most, first["first"], first["last"]) == (3.0, 1.0, 0.0, 2.0, 0.0, 2.0)


def test_forecasts_against_plain_least_squares(spark):
    import numpy as np

    from skeinql.operators import timeseries

    rng = np.random.default_rng(8)
    shocks, x = rng.normal(0, 1, 400), [5.0]
    for k in range(1, 400):
        x.append(2 + 0.6 * x[-1] + shocks[k] + 0.5 * shocks[k - 1])
    df = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(x)], "s string, t long, v double")
    rows = np.array([[1, x[k - 1], x[k - 2]] for k in range(2, 400)])
    a, b, c = np.linalg.solve(rows.T @ rows, rows.T @ np.array(x[2:]))
    want = [a + b * x[-1] + c * x[-2]]
    want.append(a + b * want[0] + c * x[-1])
    got = [r.forecast for r in timeseries.autoregression(df, ["s"], "t", "v", 2).orderBy("step").collect()]
    assert np.allclose(got, want)
    moving = [r.forecast for r in timeseries.autoregression(df, ["s"], "t", "v", 1, order=1, moving=1).collect()]
    assert abs(moving[0] - (2 + 0.6 * x[-1] + 0.5 * shocks[-1])) < 0.4  # near what the true shocks give
    d = spark.createDataFrame([("s", k, 3.0 * k + 1) for k in range(30)], "s string, t long, v double")
    assert np.allclose([r.forecast for r in timeseries.autoregression(d, ["s"], "t", "v", 3, order=1, difference=1).orderBy("step").collect()], [91, 94, 97])


def test_louvain_finds_planted_communities(spark):
    cliques = [(10 * c + i, 10 * c + j) for c in range(6) for i in range(6) for j in range(i)]
    bridges = [(10 * c, 10 * ((c + 1) % 6) + 1) for c in range(6)]
    e = spark.createDataFrame(cliques + bridges, "src long, dst long")
    v = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    found = graph.louvain(v, e)
    groups = {}
    for r in found.collect():
        groups.setdefault(r.community, set()).add(r.id // 10)
    assert all(len(own) <= 2 for own in groups.values()) and graph.modularity(e, found).first().q >= 0.68


def test_sample_with_replacement(spark):
    got = approximate.with_replacement(spark.range(20_000), 0.5, 3)
    n = got.count()
    assert abs(n - 10_000) < 500 and got.distinct().count() < n


def test_text_search(spark):
    df = spark.createDataFrame([(1, "The quick brown fox"), (2, "quick and brown"), (3, None)], "id int, t string")
    ids = lambda c: [r.id for r in df.where(c).orderBy("id").collect()]
    assert ids(textsearch.phrase(F.col("t"), ["quick", "brown"])) == [1]
    assert ids(textsearch.boolean(F.col("t"), "brown AND NOT (fox OR dog)")) == [2]
    assert ids(textsearch.wildcard(F.col("t"), "qu?ck")) == [1, 2] and ids(textsearch.fuzzy(F.col("t"), "foks", 2)) == [1]


def test_versions(spark):
    v = temporal.versions_of(spark.createDataFrame([(1, 10, "a"), (1, 20, "b")], "k int, at int, s string"), ["k"], "at")
    assert temporal.as_of(v, F.lit(15)).first().s == "a" and temporal.as_of(v, F.lit(20)).first().s == "b" and temporal.as_of(v, F.lit(5)).count() == 0
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, s string"), spark.createDataFrame([(2, "z"), (3, None)], "k int, s string")
    changes = temporal.change_capture(a, b, ["k"])
    assert {(r.op, r.k) for r in changes.collect()} == {("delete", 1), ("update", 2), ("insert", 3)}
    assert temporal.apply_changes(a, changes, ["k"]).exceptAll(b).count() == 0


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.create_table("t", "id int, n int, s string", primary_key=["id"], checks={"n": "n > 0"}, defaults={"n": 1})
    c.insert("t", [{"id": 1, "s": "a"}, {"id": 2, "n": 5}])
    for bad in ({"id": 1}, {"id": 3, "n": 0}, {"s": "no id"}):
        with pytest.raises(ConstraintError):
            c.insert("t", [bad])
    assert c.table("t").count() == 2 and c.table("t", 0).count() == 0
    c.update("t", {"n": 9}, "s IS NULL")
    assert {(r.id, r.n) for r in c.table("t").collect()} == {(1, 1), (2, 9)}
    c.drop_table("t")
    with pytest.raises(KeyError):
        c.table("t")
    c.grant("r", "select", "t")
    assert c.allowed("r", "select", "t") and not c.allowed("r", "update", "t")


def _family(spark, tmp_path, **actions):
    c = Catalog(spark, str(tmp_path))
    c.create_table("a", "id int", primary_key=["id"])
    c.create_table("b", "id int, a int", primary_key=["id"], foreign_keys={"a": ("a", "id", actions.get("b", "cascade"), actions.get("b_moves", "cascade"))})
    c.create_table("c", "id int, b int", foreign_keys={"b": ("b", "id", actions.get("c", "cascade"), "cascade")})
    c.insert("a", [{"id": i} for i in range(3)])
    c.insert("b", [{"id": 10 + i, "a": i % 3} for i in range(6)])
    c.insert("c", [{"id": 100 + i, "b": 10 + i % 6} for i in range(12)])
    return c


def ids(c, name):
    return sorted(r.id for r in c.table(name).collect())


def test_deletes_follow_references(spark, tmp_path):
    c = _family(spark, tmp_path)
    c.delete("a", "id = 1")
    assert ids(c, "a") == [0, 2] and ids(c, "b") == [10, 12, 13, 15] and len(ids(c, "c")) == 8  # grandchildren as well


def test_a_forbidden_delete_changes_nothing(spark, tmp_path):
    c = _family(spark, tmp_path, c="restrict")
    with pytest.raises(ConstraintError):
        c.delete("a", "id = 1")
    assert (len(ids(c, "a")), len(ids(c, "b")), len(ids(c, "c"))) == (3, 6, 12) and c.versions("b") == 2
    with pytest.raises(ConstraintError):
        c.truncate("b")
    with pytest.raises(ConstraintError):
        c.drop_table("a")


def test_changed_keys_and_nulls(spark, tmp_path):
    c = _family(spark, tmp_path, b="set null")
    c.update("a", {"id": 77}, "id = 1")
    assert sorted(r.a for r in c.table("b").collect()) == [0, 0, 2, 2, 77, 77]
    c.delete("a", "id = 77")
    assert sorted((r.a is None, r.a or 0) for r in c.table("b").collect()) == [(False, 0), (False, 0), (False, 2), (False, 2), (True, 0), (True, 0)] and len(ids(c, "c")) == 12
    c.create_table("tree", "id int, up int", primary_key=["id"], foreign_keys={"up": ("tree", "id", "cascade")})
    c.insert("tree", [{"id": 1}, {"id": 2, "up": 1}, {"id": 3, "up": 2}, {"id": 4}])
    c.delete("tree", "id = 1")
    assert ids(c, "tree") == [4]


def test_restricted_key_changes(spark, tmp_path):
    c = _family(spark, tmp_path, b_moves="restrict")
    with pytest.raises(ConstraintError):
        c.update("a", {"id": 77}, "id = 1")
    assert ids(c, "a") == [0, 1, 2]


def test_renamed_columns_keep_their_constraints(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.create_table("t", "id int, n int, s string", primary_key=["id"], unique=[["n"]], checks={"n": "n > 0 AND s <> 'n'"}, defaults={"n": 4})
    c.create_table("child", "t int", foreign_keys={"t": ("t", "id", "cascade")})
    c.alter("t", "rename", "n", "m")
    c.alter("t", "rename", "id", "key")
    c.insert("t", [{"key": 1, "s": "a"}])
    c.insert("child", [{"t": 1}])
    for bad in ({"key": 1, "m": 9, "s": "a"}, {"key": 2, "m": 4, "s": "a"}, {"key": 2, "m": -1, "s": "a"}, {"key": 2, "m": 9, "s": "n"}):
        with pytest.raises(ConstraintError):
            c.insert("t", [bad])
    with pytest.raises(ConstraintError):
        c.alter("t", "drop", "m")
    c.drop_constraint("t", ["m"])
    c.insert("t", [{"key": 2, "m": 4, "s": "a"}])
    c.create_index("i", "t", ["s", "key"], unique=True)
    with pytest.raises(KeyError):
        c.drop_constraint("t", "none")
    c.drop_index("i")
    assert c._read_meta("t")["unique"] == []


def test_rights_databases_and_what_is_kept(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.create_table("t", "id int")
    c.insert("t", [{"id": 1}])
    c.create_view("v", "SELECT id + 1 AS id FROM t")
    c.grant("reader", "select", "v")
    who = c.as_role("reader")
    assert [r.id for r in who.sql("SELECT * FROM v").collect()] == [2]
    for f in (lambda: who.table("t"), lambda: who.sql("SELECT * FROM t"), lambda: who.insert("t", [{"id": 2}]), lambda: who.delete("t", "true")):
        with pytest.raises(PermissionError):
            f()
    again = Catalog(spark, str(tmp_path))
    assert again.views == c.views and again.allowed("reader", "select", "v")
    again.revoke("reader", "select", "v")
    again.drop_view("v")
    with pytest.raises(KeyError):
        again.drop_view("v")
    db = c.create_database("inner")
    db.create_table("x", "id int")
    assert c.databases() == ["inner"] and c.database("inner").tables() == ["x"] and c.tables() == ["t"]
    with pytest.raises(ConstraintError):
        c.drop_database("inner")
    c.drop_database("inner", cascade=True)
    assert c.databases() == []


def test_triggers_cursors_and_packages(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.create_table("t", "id int, n int")
    c.create_row_trigger("t", "insert", {"n": "n * 10"}, "id > 1")
    c.insert("t", [{"id": 1, "n": 1}, {"id": 2, "n": 2}])
    assert sorted((r.id, r.n) for r in c.table("t").collect()) == [(1, 1), (2, 20)]
    seen = []
    c.create_trigger("t", "instead of", "delete", lambda rows: seen.append(rows.count()))
    c.delete("t", "true")
    assert seen == [2] and c.table("t").count() == 2
    cursor = Cursor(lambda low: c.table("t").where(F.col("id") >= low).orderBy("id")).open(1)
    assert cursor.fetch().id == 1 and [r.id for r in cursor.fetch_bulk(5)] == [2] and cursor.fetch() is None and cursor.row_count == 2 and not cursor.found
    cursor.close()
    with pytest.raises(CursorError):
        cursor.fetch()
    assert [r.id for r in Cursor(lambda: c.table("t").orderBy("id"))] == [1, 2]
    c.triggers.clear()
    assert forall(c, "t", "update", spark.createDataFrame([(2, 5)], "id int, n int"), ["id"]) == 1
    assert forall(c, "t", "delete", spark.createDataFrame([(1,)], "id int"), ["id"]) == 1 and [(r.id, r.n) for r in c.table("t").collect()] == [(2, 5)]
    p = Package(c, "pkg", calls=0)
    p.procedure("hidden", lambda own, x: own.state.update(calls=own.state["calls"] + 1) or x + 1, public=False)
    p.procedure("twice", lambda own, x: own.run("hidden", own.run("hidden", x)))
    assert c.call("pkg.twice", 1) == 3 and p.state["calls"] == 2
    with pytest.raises(PermissionError):
        p.call("hidden", 1)


def test_cache_tells_literals_apart(spark):
    spark.createDataFrame([("A",), ("a",)], "x string").createOrReplaceTempView("letters")
    cache = ResultCache()
    assert [r.x for r in cache.get(spark, "SELECT x FROM letters WHERE x = 'A'", ["letters"]).collect()] == ["A"]
    assert [r.x for r in cache.get(spark, "SELECT x FROM letters WHERE x = 'a'", ["letters"]).collect()] == ["a"] and cache.misses == 2
    cache.get(spark, "select  x from letters where x = 'A' ", ["letters"])
    assert cache.hits == 1
    spark.createDataFrame([("B",)], "x string").createOrReplaceTempView("letters")
    assert cache.get(spark, "SELECT x FROM letters WHERE x = 'A'", ["letters"]).count() == 0


def test_views_answer_what_they_can(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0), (2, "a", 5.0)], "k int, g string, v double")
    now, held = [0.0], [rows]
    store = ViewStore(spark, str(tmp_path), clock=lambda: now[0])
    store.base("t", lambda: held[0])
    store.create("fine", "t", ["k", "g"], ["v"], RefreshPolicy("periodic", 10))
    store.create("coarse", "t", ["k"], ["v"], RefreshPolicy("commit"))
    ask = lambda **how: store.ask("t", ["k"], {"s": ("sum", "v"), "n": ("count", ""), "m": ("avg", "v")}, **how)
    got, name = ask()
    assert name == "coarse" and sorted(map(tuple, got.collect())) == [(1, 5.0, 2, 2.5), (2, 5.0, 1, 5.0)]
    got, name = ask(where="g = 'a'", filtered=["g"])
    assert name == "fine" and sorted(r.s for r in got.collect()) == [2.0, 5.0]
    assert ask(where="v > 2", filtered=["v"])[1] is None
    more = spark.createDataFrame([(1, "a", 10.0)], rows.schema)
    held[0] = rows.union(more)
    store.changed("t", added=more)
    got, name = ask()
    assert name == "coarse" and {r.k: r.s for r in got.collect()} == {1: 15.0, 2: 5.0}
    assert ask(where="g = 'a'", filtered=["g"])[1] is None  # stale until it is due
    now[0] = 11
    got, name = ask(where="g = 'a'", filtered=["g"])
    assert name == "fine" and sorted(r.s for r in got.collect()) == [5.0, 12.0]


def test_cache_and_plans(spark):
    now = [0.0]
    cache = ResultCache(entries=1, seconds=10, clock=lambda: now[0])
    cache.get(spark, "SELECT 1 AS x", ["t"])
    cache.get(spark, "select  1 as x;", ["t"])
    now[0] = 11
    cache.get(spark, "SELECT 1 AS x", ["t"])
    assert (cache.hits, cache.misses) == (1, 2)
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    q = Query(orders).where({"field": "o_totalprice", "op": "Gt", "value": 1000}).select("o_orderkey").run()
    assert any("o_totalprice" in p for p in pushed_filters(q)) and any("Scan" in k for k in plan_report(q))


def test_quality_and_sketches(spark):
    df = spark.createDataFrame([("a1", 1), (None, 2), ("b", 3)], "s string, n int")
    got = {r.rule: r.score for r in quality.check_rules(df, {"full": quality.completeness("s"), "unique": quality.uniqueness("s"), "digits": quality.format_share("s", r"\d")}).collect()}
    assert got == {"full": pytest.approx(2 / 3), "unique": 1.0, "digits": 0.5}
    assert approximate.systematic(spark.range(100), 10, ["id"], 3).count() == 10
    assert spark.createDataFrame([("4111 1111 1111 1234",)], "c string").select(quality.MASKS["card"](F.col("c")).alias("c")).first().c == "**** **** **** 1234"


def test_far_vertices_and_neighbours(spark):
    """Chains longer than any default depth, a cheapest path of many edges, and points with few others near."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(24)], "src long, dst long")
    near = {r.id: r.closeness for r in graph.closeness(spark.createDataFrame([(0,)], "id long"), chain).collect()}
    assert near[0] == pytest.approx(24 / sum(range(1, 25)))
    rows = [(i, i + 1, 1.0) for i in range(8)] + [(0, 8, 9.0), (0, 4, 20.0), (4, 0, 0.0), (3, 5, 2.5), (8, 9, 0.0)]
    paths = graph.k_shortest_paths(spark.createDataFrame(rows, "src long, dst long, w double"), 0, 8, 3, weight="w", batch=1).collect()
    assert [(r.path, r.cost) for r in paths] == [(list(range(9)), 8.0), ([0, 1, 2, 3, 5, 6, 7, 8], 8.5), ([0, 8], 9.0)]
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 50.0, 0.0)], "id long, x double, y double")
    got = sorted((r.a, r.b) for r in spatial.nearest(points, points, 2).collect())
    assert got == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 2), (3, 3)]


def _stacked(spark, n=20_000):
    """Very many points at one place, some one step away, one far off and two without a place; all pairs would be n * n."""
    x = F.when(F.col("id") < n, 0.0).when(F.col("id") < n + 3, 1.0).when(F.col("id") == n + 3, 50.0).when(F.col("id") == n + 4, F.lit(float("nan")))
    return spark.range(n + 6).select("id", x.alias("x"), F.lit(0.0).alias("y"), (F.col("id") % 7).cast("double").alias("v"))

def test_near_pairs_of_places(spark, monkeypatch):
    """Ids are paired after their places met: each pair once, also where a place is cut into chunks."""
    monkeypatch.setattr(spatial, "CHUNK", 3)
    points = _stacked(spark, 40)
    got = sorted((r.a, r.b, r.distance) for r in spatial.near_pairs(points, points, 2.0).collect())
    assert got == sorted((a, b, float((a < 40) != (b < 40))) for a in range(44) for b in range(44) if (a == 43) == (b == 43))

def test_nearest_of_places(spark):
    points = _stacked(spark)
    got = spatial.nearest(points, points, 3, 5.0)
    assert [tuple(r) for r in got.where("a < 20000").groupBy("b", "distance").count().orderBy("b").collect()] == [(0, 0.0, 20_000), (1, 0.0, 20_000), (2, 0.0, 20_000)]
    assert sorted((r.a, r.b, r.distance) for r in got.where("a >= 20000").collect()) == [(a, b, 0.0) for a in (20000, 20001, 20002) for b in (20000, 20001, 20002)] + [(20003, 20003, 0.0)]

def test_dbscan_of_places(spark):
    """Copies count as neighbours; noise and points without a place have no cluster."""
    got = spatial.dbscan(_stacked(spark), 1.5, 5).groupBy("cluster").agg(F.count("*").alias("n"), F.max("id").alias("last")).collect()
    assert sorted((r.cluster, r.n, r.last) for r in got if r.cluster is not None) == [(0, 20_003, 20_002)] and [(r.n, r.last) for r in got if r.cluster is None] == [(3, 20_005)]
    got = {r.id: r.cluster for r in spatial.dbscan(spark.createDataFrame([(9, 0.0, 0.0), (3, 0.0, 0.0), (4, 1.0, 0.0), (1, 2.0, 0.0)], "id long, x double, y double"), 1.0, 4).collect()}
    assert got == {9: 4, 3: 4, 4: 4, 1: 4}

def test_hot_spots_of_places(spark):
    """As the SQL has it, with repeated ids too: their rows add up."""
    rows = [(1, 0.0, 0.0, 1.0), (1, 0.0, 0.0, 2.0), (2, 1.0, 0.0, 5.0), (3, 9.0, 0.0, 4.0), (4, 30.0, 0.0, None)]
    got = {r.id: r.z for r in spatial.hot_spots(spark.createDataFrame(rows, "id long, x double, y double, v double"), "v", 3.0).collect()}
    m, sd, n = 3.0, (10 / 4) ** 0.5, 5
    z = lambda t, k: (t - m * k) / (sd * ((n * k - k * k) / (n - 1)) ** 0.5)
    assert got[2] == pytest.approx(z(8.0, 3)) and got[3] == pytest.approx(z(4.0, 1)) and got[4] is None and 1 in got
    assert spatial.hot_spots(_stacked(spark), "v", 3.0).count() == 20_004

def test_morans_i_of_places(spark):
    rows = [(1, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 2.0), (3, 1.0, 0.0, 5.0), (4, 2.0, 0.0, None), (5, 30.0, 0.0, 4.0)]
    pairs = [(a, b) for a in rows for b in rows if a[0] != b[0] and abs(a[1] - b[1]) <= 1.0]
    want = sum((a[3] - 3) * (b[3] - 3) for a, b in pairs if a[3] and b[3]) / len(pairs) / (10 / 4)
    frame = spark.createDataFrame(rows, "id long, x double, y double, v double")
    assert spatial.morans_i(frame, "v", 1.0).first().i == pytest.approx(want)
    assert spatial.morans_i(frame.where("id > 3"), "v", 1.0).first().i is None
    assert spatial.morans_i(_stacked(spark), "v", 3.0).first().i == pytest.approx(0.0, abs=1e-3)


def _star(spark, leaves):
    """A vertex 0 with many twins around it, both ways, and one more vertex behind one of them."""
    e = spark.range(1, leaves + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")).union(spark.createDataFrame([(1, -1)], "src long, dst long"))
    return e.union(e.select("dst", "src"))

def test_distances_of_twins(spark, monkeypatch):
    """Twins are searched as one class; every pair is there, and twins that are too far from one another are not."""
    monkeypatch.setattr(graph, "CLASS_CHUNK", 2)
    e, v = _star(spark, 5), spark.range(-1, 6)
    of, reduced = graph._classes(e, v)
    assert of.select("rep").distinct().count() == 4 and reduced.count() == 6
    far = lambda a, b: 0 if a == b else 1 if 0 in (a, b) and -1 not in (a, b) or {a, b} == {1, -1} else 2 if -1 not in (a, b) or 0 in (a, b) else 3
    every = {(a, b): float(far(a, b)) for a in range(-1, 6) for b in range(-1, 6)}
    assert {(r.source, r.id): r.distance for r in graph.distances(e, v).collect()} == every
    assert {(r.source, r.id): r.distance for r in graph.distances(e, v, 1).collect()} == {k: d for k, d in every.items() if d <= 1}

def test_closeness_of_twins(spark):
    got = {r.id: r.closeness for r in graph.closeness(spark.range(-1, 3), _star(spark, 3000)).collect()}
    assert got == {0: pytest.approx(3001 / 3002), 1: pytest.approx(3001 / (2 + 2 * 2999)), 2: pytest.approx(3001 / (1 + 2 * 2999 + 3)), -1: pytest.approx(3001 / (1 + 2 + 3 * 2999))}

def test_betweenness_of_twins(spark):
    """Of k equal ways each vertex gets a k-th."""
    e, v = _star(spark, 3000), spark.range(-1, 3001)
    got = {r.id: r.betweenness for r in graph.betweenness(v, e).where("id < 4").collect()}
    assert got == {0: 3000 * 2999 + 2 * 2999, 1: 2 * 3000, 2: 0, 3: 0, -1: 0}
    ways = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 9), (2, 9), (3, 9)], "src long, dst long")
    assert {r.id: round(r.betweenness, 9) for r in graph.betweenness(spark.createDataFrame([(0,), (1,), (9,)], "id long"), ways).collect()} == {0: 0, 1: round(1 / 3, 9), 9: 0}

def test_influence_of_twins(spark):
    e = _star(spark, 3000)
    assert graph.influence(e, 3, 2) == [0] and graph.influence(e, 3, 1) == [0, -1]
    assert graph.influence(spark.createDataFrame([(5, 9), (4, 9), (7, 8)], "src long, dst long"), 9, 2) == [4, 7, 5]


def test_heavy_hitters_of_many_values(spark):
    """Far more values than a sketch has counters, nearly equally frequent: the most frequent are found and counted exactly."""
    rows = spark.range(40_000).select((F.col("id") % 20_000).alias("v")).union(spark.createDataFrame([(7,), (7,), (11,), (None,), (None,), (None,), (None,)], "v long"))
    assert {tuple(r) for r in approximate.heavy_hitters(rows, "v", 3, True).collect()} == {(7, 4), (None, 4), (11, 3)}
    assert approximate.heavy_hitters(rows.limit(0), "v", 3, True).count() == 0


def test_k_shortest_query_keeps_the_bound_of_its_sql(spark, duck, same, tmp_path):
    """A chain of four edges: the SQL has no path of so many."""
    from skeinql.queries import q07_graph

    rows = [(o, p + o) for o in range(1, 5) for p in (0, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    duck.execute(f"CREATE OR REPLACE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    same(q07_graph.QUERIES["graph_k_shortest"](spark, str(tmp_path)), duck.execute(q07_graph.ORACLES["graph_k_shortest"]))


def test_approx_distinct_query_keeps_no_sketch_for_each_value(spark):
    from skeinql.queries import q08_quality

    plan = q08_quality.QUERIES["approx_distinct"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "approx_count_distinct" in line and "count(distinct" in line]


def test_edges_are_made_in_tasks_that_grow_in_number(spark, duck, same, monkeypatch):
    from skeinql.queries import q07_graph

    monkeypatch.setattr(q07_graph, "EDGE_ROWS", 1000)
    edges = q07_graph._edges(spark, "/root/testdata/sf0.001")
    assert edges.rdd.getNumPartitions() == 2 * (6000 // 1000 + 1)
    same(q07_graph.QUERIES["graph_csr"](spark, "/root/testdata/sf0.001"), duck.execute(q07_graph.ORACLES["graph_csr"]))


def test_lists_of_neighbours_meet_in_blocks(spark, monkeypatch):
    """Against plain loops, with hubs, repeated and reversed edges and loops, cut into many blocks; no list is joined to each edge."""
    import random

    from skeinql.operators import adjacency

    for name, value in {"BLOCK_EDGES": 60, "LIST_EDGES": 100, "MARKS": 64, "LOOKS": 50}.items():
        monkeypatch.setattr(adjacency, name, value)
    r = random.Random(5)
    rows = [(r.randrange(60), r.randrange(60)) for _ in range(300)] + [(30, i) for i in range(200)] + [(i, 31) for i in range(0, 200, 2)] + [(4, 4), (4, 9), (9, 4), (4, 9)]
    e = spark.createDataFrame(rows, "src long, dst long")
    near = {v: {b for a, b in rows + [(b, a) for a, b in rows] if a == v != b} for v in range(200)}
    three = {(a, b, c) for a in near for b in near[a] if a < b for c in near[a] & near[b] if b < c}
    found = graph.triangles(e)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(t) for t in found.collect()) == sorted(three)
    words = graph.triangles(e.select(F.concat(F.lit("v"), "src").alias("src"), F.concat(F.lit("v"), "dst").alias("dst"))).collect()
    assert sorted(tuple(t) for t in words) == sorted(tuple(sorted(f"v{i}" for i in t)) for t in three)
    want = {v: 2 * sum(v in t for t in three) / (len(n) * (len(n) - 1)) if len(n) > 1 else 0.0 for v, n in near.items() if n}
    assert {c.id: c.coefficient for c in graph.clustering(e).collect()} == pytest.approx(want)
    out = {v: {b for a, b in rows if a == v} for v in range(205)}
    pairs = sorted({(a, b) for a in (0, 4, 30, 204) for b in range(0, 60, 3)})
    got = {(s.a, s.b): (s.common, s.jaccard, s.cosine) for s in graph.similarity(e, spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert sorted(got) == pairs
    for (a, b), (common, jaccard, cosine) in got.items():
        both, either = len(out[a] & out[b]), len(out[a] | out[b])
        assert (common, jaccard) == (both, pytest.approx(both / either if either else 0.0))
        assert cosine == pytest.approx(both / (len(out[a]) * len(out[b])) ** 0.5 if out[a] and out[b] else 0.0)
    assert {(s.a, s.b) for s in graph.similarity(e).collect()} == set(rows)
    assert graph.triangles(e.limit(0)).count() == 0


def test_hyperedges_are_paired_in_tasks_that_grow_in_number(spark, duck, same, monkeypatch):
    from skeinql.operators import hypergraph
    from skeinql.queries import q07_graph

    monkeypatch.setattr(hypergraph, "MEMBER_ROWS", 1000)
    assert hypergraph._pairs(q07_graph._baskets(spark, "/root/testdata/sf0.001"))[0].rdd.getNumPartitions() == 4 * (6000 // 1000 + 1)
    for name in ("hyper_degrees", "hyper_expansion"):
        same(q07_graph.QUERIES[name](spark, "/root/testdata/sf0.001"), duck.execute(q07_graph.ORACLES[name]))


def test_orders_over_all_rows_are_cut_in_pieces(spark, duck, same, monkeypatch):
    from skeinql.operators import windows
    from skeinql.queries import q12_storage, q13_events
    from skeinql.streaming import continuous

    monkeypatch.setattr(windows, "PIECE_ROWS", 30)
    assert windows.in_pieces(spark.range(100), ["id"])[0].select("_piece").distinct().count() == 4
    folder = "/root/testdata/sf0.001"
    same(q12_storage.QUERIES["encode_choice"](spark, folder), duck.execute(q12_storage.ORACLES["encode_choice"]))
    same(q13_events.QUERIES["stream_lateness"](spark, folder), duck.execute(q13_events.ORACLES["stream_lateness"]))
    rows = spark.range(200).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), F.expr("timestamp '2020-01-01' + make_interval(0, 0, 0, 0, 0, pmod(id * 37, 101))").alias("t"))
    sql = "SELECT id, max(t) OVER (PARTITION BY k ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 5 MINUTES AS w FROM rows"
    rows.createOrReplaceTempView("rows")
    late = continuous.lateness(rows, "t", "id", "5 minutes", keys=["k"])
    assert late.columns == ["id", "k", "t", "watermark", "handling"]
    assert {(r.id, r.watermark) for r in late.collect()} == {(r.id, r.w) for r in spark.sql(sql).collect()}


def test_quantiles_are_exact_in_pieces(spark, duck, same, monkeypatch):
    """As Spark's own percentile, with nulls, equal values and a group without values, but no task has all values of a group."""
    from skeinql.operators import timeseries, windows
    from skeinql.queries import q02_relational, q08_quality

    monkeypatch.setattr(windows, "PIECE_ROWS", 40)
    rows = spark.range(500).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 11 > 0, F.pmod(F.col("id") * 37, F.lit(211)) / 7).alias("v")).union(spark.createDataFrame([(None, 2.0), (None, 3.0), (9, None)], "k long, v double"))
    got = {r.k: tuple(r)[1:] for r in timeseries.exact_quantiles(rows, ["k"], "v", {"a": 0.5, "b": 0.9, "c": 0.5}, ["c"]).collect()}
    want = rows.groupBy("k").agg(F.percentile("v", 0.5), F.percentile("v", 0.9), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)")).collect()
    assert got == {r.k: tuple(r)[1:] for r in want}
    folder = "/root/testdata/sf0.001"
    for module, name in ((q02_relational, "agg_median_mode"), (q08_quality, "percentile_interval")):
        found = module.QUERIES[name](spark, folder)
        assert not [p for p in ("percentile(", "median(") if p in found._jdf.queryExecution().optimizedPlan().toString()]
        same(found, duck.execute(module.ORACLES[name]))


def test_one_statement_takes_many_fetches(spark, monkeypatch, tmp_path):
    from skeinql.queries import q14_more

    for name in ("region", "nation"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.range(120).select(F.col("id").alias("s_suppkey"), F.when(F.col("id") == 7, 4).otherwise(5).alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    sizes, plain = [], q14_more.forall
    monkeypatch.setattr(q14_more, "forall", lambda c, name, event, rows, key: sizes.append((event, rows.count())) or plain(c, name, event, rows, key))
    got = q14_more.QUERIES["cursor_bulk_forall"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == [(i, 6) for i in range(120) if i != 7]
    assert sizes == [("update", 119), ("delete", 1)]

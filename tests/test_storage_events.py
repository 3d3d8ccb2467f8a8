"""Indexes, partitions, shards, event stores, continuous queries, JSON schemas, samples and users' aggregates: odd cases and errors."""

import datetime
import math
import os
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.errors import PythonException
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from skeinql.functions.aggregates import UserAggregate, aggregate
from skeinql.operators import documents, hypergraph, indexes, joins, learning, olap, partitioning, perceptron, timeseries
from skeinql.streaming import continuous, streams
from skeinql.streaming.event_store import ChangeLog, EventStore, ReadModel, VersionConflict


def test_bitmaps_with_nulls_and_nothing(spark):
    df = spark.createDataFrame([(0, "a"), (63, None), (64, "a"), (200, "b")], "row long, v string")
    index, every = indexes.bitmap_index(df, "row", "v"), indexes.all_rows(df, "row")
    rows = lambda b: sorted(r.row for r in indexes.bitmap_rows(b).collect())
    assert rows(indexes.bitmap(index, "a")) == [0, 64] and rows(indexes.bitmap(index, "none")) == [] and rows(indexes.bitmap_not(indexes.bitmap(index, "a"), every)) == [63, 200]
    assert rows(indexes.bitmap_and(indexes.bitmap(index, "a"), indexes.bitmap(index, "b"))) == [] and indexes.bitmap_count(every).first().n == 4


def test_lsm_newest_wins(spark, tmp_path):
    lsm = indexes.LsmIndex(spark, str(tmp_path), "k", "k long, v string", runs=2)
    put = lambda *rows: lsm.put(spark.createDataFrame(rows, "k long, v string"))
    assert lsm.scan().count() == 0
    put((1, "a"), (2, "b"))
    put((1, "c"))
    lsm.delete(spark.createDataFrame([(2,), (9,)], "k long"))
    assert {(r.k, r.v) for r in lsm.scan().collect()} == {(1, "c")} and len(lsm.runs) == 1
    put((2, "d"))
    assert [r.v for r in lsm.get(2).collect()] == ["d"] and lsm.get(7).count() == 0


def test_covering_index_says_what_it_covers(spark, tmp_path):
    index = indexes.CoveringIndex(spark, str(tmp_path / "i"), {"k": "k"}, ["v"], where="v > 1").build(spark.createDataFrame([(1, 1), (2, 2)], "k int, v int"))
    assert index.covers(["k", "v"], "v > 1") and not index.covers(["k"]) and not index.covers(["w"], "v > 1") and index.find("k > 0").count() == 1


def test_encodings_round_trip(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 9), ("b", 1, None), ("b", 2, 7)], "g string, o int, v int")
    coded, names = indexes.dictionary_encoded(df, "v")
    assert coded.join(names, "code").count() == 4 and coded.where("code IS NULL").count() == 1
    runs = indexes.run_lengths(df, ["g"], "o", "v")
    assert sorted((r.g, r.value, r.length) for r in runs.where("value IS NOT NULL").collect()) == [("a", 5, 2), ("a", 9, 1), ("b", 7, 1)]
    assert {(r.g, r.base, r.width) for r in indexes.framed(df, ["g"], "v").collect()} == {("a", 5, 3), ("b", 7, 0)}


def test_range_partitions(spark, tmp_path):
    date = datetime.date
    p = partitioning.RangePartitions(spark, str(tmp_path), "d")
    p.add_periods(date(2024, 1, 31), 3, "month")
    assert [(a, b) for a, b, _ in p.ranges] == [(date(2024, m, 1), date(2024, m + 1, 1)) for m in (1, 2, 3)]
    rows = spark.createDataFrame([(date(2024, 1, 5),), (date(2024, 1, 20),), (date(2024, 3, 31),)], "d date")
    p.insert(rows)
    with pytest.raises(ValueError):
        p.insert(spark.createDataFrame([(date(2025, 1, 1),)], "d date"))
    with pytest.raises(ValueError):
        p.add(date(2024, 1, 15), date(2024, 6, 1))
    with pytest.raises(ValueError):
        p.merge(date(2024, 1, 1), date(2024, 2, 15))
    p.split(date(2024, 1, 1), date(2024, 1, 10))
    assert p.read(date(2024, 1, 1), date(2024, 1, 10)).count() == 1 and p.read().count() == 3
    p.merge(date(2024, 1, 1), date(2024, 3, 1))
    p.drop(date(2024, 3, 1))
    assert p.read().count() == 2


def test_shards(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 5) for i in range(50)], "id int, k int")
    for kind, more in (("hash", {}), ("range", {"bounds": [2, 4]}), ("list", {"lists": {"a": [0, 1], "b": [2]}})):
        m = partitioning.ShardMap(spark, [str(tmp_path / f"{kind}{n}") for n in range(3)], "k", kind, **more)
        m.write(rows)
        assert m.read().count() == 50 and m.read(1, 4).count() == 20


def test_partitioned_write_of_a_hot_value(spark, tmp_path):
    df = spark.range(1000).withColumn("p", F.when(F.col("id") < 900, "hot").when(F.col("id") < 950, "cold"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that small tasks stay apart
    try:
        partitioning.write_partitioned(df, str(tmp_path / "t"), rows_per_task=100, q=F.col("p"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1000 and len(list((tmp_path / "t" / "q=hot").glob("*.parquet"))) > 1


def test_joins_for_hot_keys_equal_plain_joins(spark):
    left = spark.createDataFrame([(None if i % 50 == 0 else 1 if i < 700 else i, i) for i in range(1000)], "k int, i int")
    right = spark.createDataFrame([(k, f"v{k}") for k in [1, 1, *range(800, 900)]] + [(None, "null")], "k int, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        same = lambda d: sorted(map(str, d.collect()))
        assert same(joins.salted_join(left, right, "k", 4, how)) == same(left.join(right, "k", how))
    times = spark.createDataFrame([("a" if i % 3 else None, i) for i in range(200)], "k string, t int")
    marks = spark.createDataFrame([("a" if i % 2 else None, 3 * i, f"m{i}") for i in range(60)], "k string, t int, v string")
    whole = {(r.k, r.t): r.v for r in joins.asof_join(times, marks, ["k"], "t", "t", ["v"], pieces=1).collect()}
    assert {(r.k, r.t): r.v for r in joins.asof_join(times, marks, ["k"], "t", "t", ["v"], pieces=7).collect()} == whole and whole[("a", 1)] is None and whole[("a", 4)] == "m1"


def test_exact_ranks(spark):
    import random

    rng = random.Random(1)
    rows = [(g, rng.choice([rng.random(), 0.5])) for g in ("a", None) for _ in range(3001)] + [("one", 7.0), ("none", None)]
    got = {r.g: (r.q1, r.m) for r in timeseries._at_rank(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"q1": 0.25, "m": 0.5}).collect()}
    for g in ("a", None, "one"):
        own = sorted(v for x, v in rows if x == g)
        assert got[g] == (own[len(own) // 4], own[len(own) // 2])


def test_event_store(spark, tmp_path):
    s = EventStore(spark, str(tmp_path), "string", "n long")
    rows = lambda *r: spark.createDataFrame(r, "s string, n long, k string")
    assert s.events().count() == 0
    s.append(rows(("a", 1, "x"), ("a", 2, "y"), ("b", 5, "x")), "s", ["n"], "k", {"a": 0})
    with pytest.raises(VersionConflict):
        s.append(rows(("a", 3, "x")), "s", ["n"], "k", {"a": 1})
    s.append(rows(("a", 3, "x")), "s", ["n"], "k", {"a": 2})
    assert [(r.version, r.body.n) for r in s.read("a", 2).orderBy("version").collect()] == [(2, 2), (3, 3)]
    fold = {"total": ("sum", "body.n")}
    s.snapshot(fold)
    s.retain(F.col("body.n") > 2)
    s.append(rows(("a", 10, "x")), "s", ["n"], "k")
    assert {(r.stream, r.total) for r in s.state(fold).collect()} == {("a", 16), ("b", 5)}
    model = ReadModel(s, str(tmp_path / "m"), lambda before, new: new.groupBy("kind").count() if before is None else before.union(new.groupBy("kind").count()).groupBy("kind").agg(F.sum("count").alias("count")))
    assert {r.kind: r["count"] for r in model.catch_up().collect()} == {"x": 3}


def test_change_log_resumes(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path), ["k"])
    a, b = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "x"), (2, "y")], [(1, "z"), (3, "w")]))
    log.record(a, b)
    seen = log.watch().collect()
    assert [(r.op, r.k) for r in seen] == [("update", 1), ("delete", 2), ("insert", 3)]
    assert [r.k for r in log.watch(seen[0].token).collect()] == [2, 3] and log.watch(seen[-1].token).count() == 0


def test_continuous_query_life(spark, tmp_path):
    feed = str(tmp_path / "feed")
    spark.range(10).write.parquet(feed)
    schema, got = spark.read.parquet(feed).schema, []
    q = continuous.ContinuousQueries(spark, str(tmp_path / "q"))
    q.create("sums", lambda: streams.file_stream(spark, feed, schema), sink=lambda rows, n: got.append(rows.count()))
    for bad in (lambda: q.refresh("sums"), lambda: q.create("sums", None), lambda: q.create("t", None, sink="table"), lambda: q.create("t", None, sink="file", refresh="hourly"), lambda: q.resume("sums"), lambda: q.result("sums")):
        with pytest.raises(ValueError):
            bad()
    q.start("sums")
    q.refresh("sums")
    q.refresh("sums")
    assert sum(got) == 10 and q.status()["sums"][0] == "running"
    q.drop("sums")
    assert q.status() == {}


def test_custom_windows(spark):
    df = spark.createDataFrame([("u", i, e) for i, e in enumerate("xaxbxabba")], "k string, i int, e string")
    out = continuous.custom_window(df, ["k"], "i", F.col("e") == "a", F.col("e") == "b")
    assert [(r.i, r.window) for r in out.orderBy("i").collect()] == [(1, 1), (2, 1), (3, 1), (5, 2), (6, 2), (8, 3)]


def test_json_schema_rules():
    check = documents.check_schema
    assert check(5, {"type": ["string", "integer"], "multipleOf": 5}) == [] and check(True, {"type": "integer"}) == ["$: type"] and check(1, {"enum": [True]}) == ["$: enum"]
    assert check({"a": [1, 1], "b": "xyz"}, {"properties": {"a": {"uniqueItems": True, "maxItems": 1}, "b": {"minLength": 4, "pattern": "^y"}}}) == ["$.a: uniqueItems", "$.a: maxItems", "$.b: minLength", "$.b: pattern"]
    assert check({"x": 1, "y": 2}, {"properties": {"x": {}}, "additionalProperties": {"type": "string"}}) == ["$.y: type"] and check({"y": 2}, {"additionalProperties": False}) == ["$.y: not allowed"]
    assert check(3, {"anyOf": [{"type": "string"}, {"minimum": 5}]}) == ["$: anyOf"] and check(3, {"oneOf": [{"minimum": 1}, {"minimum": 2}]}) == ["$: oneOf"] and check(3, {"not": {"type": "integer"}}) == ["$: not"]
    assert check({"c": 1}, {"dependentRequired": {"c": ["d"]}, "required": ["e"]}) == ["$.d: required with c", "$.e: required"] and check(9, {"if": {"minimum": 5}, "then": {"maximum": 8}}) == ["$: maximum"]
    assert check([1, "a"], {"items": {"type": "integer"}, "contains": {"const": 2}}) == ["$[1]: type", "$: contains"] and check(None, {"type": "null"}) == []


def test_json_schema_of_odd_documents(spark):
    df = spark.createDataFrame([("{}",), ("{",), (None,)], "d string")
    assert [r.e for r in df.select(documents.json_schema_errors(F.col("d"), {"required": ["a"]}).alias("e")).collect()] == [["$.a: required"], ["$: malformed"], None]


def test_pattern_language(spark):
    v = spark.createDataFrame([(1, "P", "ann"), (2, "P", "bob"), (3, "C", "acme"), (4, "P", "eve")], "id long, label string, name string")
    e = spark.createDataFrame([(1, 2, "knows", 5), (2, 4, "knows", 1), (1, 3, "works", 9), (4, 1, "knows", 2)], "src long, dst long, label string, w int")
    q = lambda t: sorted(map(tuple, hypergraph.query(v, e, t).collect()))
    assert q("MATCH (a:P)-[k:knows]->(b) WHERE k.w > 1 RETURN a.name AS x, b.name AS y") == [("ann", "bob"), ("eve", "ann")]
    assert q("MATCH (a)<-[:knows]-(b), (a)-[:works]->(c:C) RETURN b.name AS b, c.name AS c") == [("eve", "acme")]
    assert q("MATCH (a)-[:knows*1..2]->(b) WHERE a.id = 1 RETURN b.name AS n") == [("bob",), ("eve",)]
    assert q("MATCH (a)-[:knows]->(b), (b)-[:knows]->(c), (c)-[:knows]->(a) RETURN a.id AS a") == [(1,), (2,), (4,)]
    assert q("MATCH (a)-[:knows]-(b) RETURN a.name AS n, count(b.id) AS c ORDER BY n LIMIT 2") == [("ann", 2), ("bob", 2)]
    for bad in ("RETURN 1", "MATCH a RETURN 1", "MATCH (a)=(b) RETURN a.id"):
        with pytest.raises(ValueError):
            hypergraph.query(v, e, bad)


def test_star_schema_and_features(spark):
    fact = spark.createDataFrame([(1, 10, 2.0), (1, 11, 3.0), (2, None, 5.0)], "a int, b int, v double")
    star = olap.StarSchema(fact).dimension("x", spark.createDataFrame([(1, "p"), (2, "q")], "id int, n string"), "a", "id").dimension("y", spark.createDataFrame([(10, "r")], "id int, n string"), "b", "id")
    assert {(r.x_n, r.s) for r in star.query(["x.n"], s=F.sum("v")).collect()} == {("p", 5.0), ("q", 5.0)}
    assert {(r.y_n, r.s) for r in star.query(["y.n"], "x.n = 'p'", s=F.sum("v")).collect()} == {("r", 2.0), (None, 3.0)}
    df = spark.createDataFrame([(float(i), float(i % 3), 1.0, 2.0 * i) for i in range(30)], "a double, b double, c double, y double")
    assert learning.select_features(df, ["a", "b", "c"], "y") == ["a", "b"] and learning.select_features(df, ["a", "b", "c"], "y", 1) == ["a"]
    n = {r.variant: r.n for r in learning.ab_assignment(spark.range(10_000), ["id"], {"a": 0.3, "b": 0.7}).groupBy("variant").agg(F.count("*").alias("n")).collect()}
    assert abs(n["a"] - 3000) < 200


def test_models_keep_rows_in_tasks_of_bounded_size(spark, monkeypatch):
    """All rows of one split are dealt to many tasks before an algorithm keeps them; the rows and the model's stages stay."""
    sizes = []

    class Spy(learning.K.KMeans):
        def _fit(self, dataset):
            sizes.extend(r["count"] for r in dataset.groupBy(F.spark_partition_id()).count().collect())
            return super()._fit(dataset)

    monkeypatch.setitem(learning.ALGORITHMS, "kmeans", Spy)
    monkeypatch.setattr(learning, "TASK_ROWS", 100, raising=False)
    df = spark.range(0, 1000, 1, 1).select((F.col("id") % 2 * 100.0).alias("a"), F.lit(1.0).alias("b"), "id")
    m = learning.create_model(df, "kmeans", ["a", "b"], k=2, seed=1)
    assert sum(sizes) == 1000 and max(sizes) <= 200 and len(m.stages) == 3
    assert sorted(r["count"] for r in learning.predict(m, df).groupBy("prediction").count().collect()) == [500, 500]


def test_perceptron_counts_each_row_once(spark):
    """However rows are split, the model is the same; Spark's own gives the one row of a short block the weight of a full one."""
    df = spark.range(0, 257, 1, 1).select((F.col("id") % 16 / 8.0).alias("a"), (F.col("id") % 5 * 1.0).alias("b"), (F.col("id") % 16 > F.col("id") % 5 * 2).cast("double").alias("y"))
    fit = lambda rows: learning.create_model(rows, "neural_network", ["a", "b"], "y", scale=None, layers=[2, 3, 2], seed=1, maxIter=8).stages[-1]
    one, many = fit(df), fit(df.repartition(7))
    assert abs(one.weights.toArray() - many.weights.toArray()).max() < 1e-9
    assert one.getMaxIter() == 8 and one.getLayers() == [2, 3, 2] and not one.isSet(one.initialWeights)


def test_perceptron_is_sparks(spark, monkeypatch):
    """Over full blocks, the weights after some rounds are those of Spark's own; gradients added up in tasks first change nothing."""
    df = spark.range(0, 512, 1, 1).select(F.array((F.col("id") % 16 / 8.0), (F.col("id") % 5 * 1.0)).alias("v"), (F.col("id") % 3).cast("double").alias("y"))
    df = df.select(array_to_vector("v").alias("features"), "y")
    params = {"labelCol": "y", "layers": [2, 4, 3, 3], "seed": 1, "maxIter": 12}
    theirs = MultilayerPerceptronClassifier(**params).fit(df)
    for limit in (1 << 24, 0):
        monkeypatch.setattr(perceptron, "GRADIENT_BYTES", limit)
        ours = perceptron.Perceptron(**params).fit(df)
        assert abs(ours.weights.toArray() - theirs.weights.toArray()).max() < 1e-8
    assert ours.transform(df).select("prediction").collect() == theirs.transform(df).select("prediction").collect()
    assert perceptron._packed(df, "features", "y", [2, 4, 3, 3]).count() == 1


@pytest.mark.parametrize("label", ["3.0", "-1.0", "0.5", "cast(null as double)"])
def test_perceptron_refuses_labels_that_are_no_class(spark, label):
    df = spark.range(4).select(array_to_vector(F.array(F.lit(1.0), F.lit(2.0))).alias("features"), F.expr(label).alias("label"))
    with pytest.raises(PythonException, match="not a whole number from 0 to 2"):
        perceptron.Perceptron(layers=[2, 3, 3], maxIter=1).fit(df)
    with pytest.raises(ValueError, match="no rows"):
        perceptron.Perceptron(layers=[2, 3, 3], maxIter=1).fit(df.where("false"))


def test_perceptron_kernel_runs_without_this_package(tmp_path):
    """Executors need not have the repository: what goes there brings its own code."""
    code = "import pickle, sys, numpy as np; f = pickle.load(sys.stdin.buffer); print(f(np.zeros(6), [2, 2], np.ones((2, 3)), np.array([0, 1, 1]))[0])"
    said = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(perceptron.loss_and_gradient), cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, timeout=60)
    assert said.returncode == 0 and abs(float(said.stdout) - 3 * math.log(2)) < 1e-12, said.stderr


def test_user_aggregate_merges_states(spark):
    longest = UserAggregate("best string", lambda: ("",), lambda s, x: (max([s[0], *x.dropna()], key=len),), lambda a, b: max(a, b, key=lambda s: len(s[0])), lambda s: s[0], "string", deterministic=False)
    df = spark.createDataFrame([("a", "x"), ("a", "xyz"), (None, "q"), ("a", None)], "k string, v string").repartition(3)
    assert {(r.k, r.m) for r in aggregate(df, ["k"], "v", longest, "m").collect()} == {("a", "xyz"), (None, "q")}


def test_column_store_population_and_eviction(spark):
    from skeinql.plans.memory import ColumnStore, FragmentCache, estimated_bytes

    now, t = [0.0], spark.createDataFrame([(i, i * 2, str(i)) for i in range(100)], "a int, b int, c string")
    size = estimated_bytes(t.select("a"))
    store = ColumnStore(int(2.5 * size), clock=lambda: now[0])
    store.register("t", t)
    store.want("t", ["a"], 1)
    store.want("t", ["b"], 5)
    assert store.populate() == [("t", ("b",)), ("t", ("a",))]
    now[0] = 5.0
    assert store.scan("t", ["b"], "b > 100")[1] and not store.scan("t", ["a", "b"])[1]
    store.want("t", ["a", "b"], 0)
    assert store.populate() == []  # not urgent enough to drive anything out
    store.want("t", ["a", "b"], 3)
    assert store.populate() in ([], [("t", ("a", "b"))]) and ("t", ("b",)) in store.status()
    now[0] = 100.0
    assert store.evict_cold(50) >= 1 and store.used() == 0
    cache = FragmentCache(1)
    assert cache.shared(t.where("a > 1")).count() == 98 and cache.shared(t.where("a > 1")).count() == 98 and cache.hits == 1
    cache.shared(t.where("a > 2"))
    cache.shared(t.where("a > 1"))
    assert cache.hits == 1


def test_bloom_join_drops_nothing_that_joins(spark):
    left = spark.createDataFrame([(i if i % 9 else None, i) for i in range(2000)], "k int, i int")
    right = spark.createDataFrame([(k, "v") for k in (1, 5, 5, 1999)] + [(None, "n")], "k int, v string")
    for bits in (64, 1 << 12):
        assert sorted(map(str, joins.bloom_join(left, right, "k", bits).collect())) == sorted(map(str, left.join(right, "k").collect()))
    assert joins.bloom_join(left, right.limit(0), "k").count() == 0


def test_schema_registry():
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL
    r = streams.SchemaRegistry()
    assert r.register("s", schema("a int")) == 1 and r.register("s", schema("a int, b string")) == 2 and r.register("s", schema("a int")) == 1
    with pytest.raises(ValueError):
        r.register("s", schema("a string"))
    assert r.get("s") == schema("a int, b string") and r.get("s", 1) == schema("a int")


def test_call_sink_hands_on_in_batches(spark, tmp_path):
    from skeinql.sources.connectors import call_sink

    path = str(tmp_path / "calls")

    def call(rows):
        with open(path, "a") as f:
            f.write(f"{len(rows)}\n")

    spark.dataSource.register(call_sink("skein_call", call))
    spark.range(0, 25, 1, 1).write.format("skein_call").option("batch", "10").mode("append").save()
    assert open(path).read().split() == ["10", "10", "5"]

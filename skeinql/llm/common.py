"""What several operators of this package share: scratch tables, bounds for broadcasts, components."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of (long) keys that may be broadcast: 2 million keys are about 100 MB as a hashed relation.
BROADCAST_KEYS = 2_000_000
#: Bytes of a batch of rows that goes to Python.
BATCH_BYTES = 8 << 20
#: Used only where driver and executors are one process and the session names no shared folder, as in tests.
OWN_SHARED_FOLDER = "/tmp/checkpoints/skeinql"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = OWN_SHARED_FOLDER
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/scratch-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{_own_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def _deleted(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cleared(spark: SparkSession) -> None:
    """Remove all scratch tables of this application, once no result that reads them is needed any more."""
    _deleted(spark, _own_folder(spark))


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """What is run inside goes to Python in batches of at most so many bytes; documents differ too much in length to bound rows only."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before.rstrip("b")) <= size:
        spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, and lost executors don't matter."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    with small_batches(spark):
        df.write.option("compression", "zstd").options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path  # for dropped()
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove scratch tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_scratch", None)
        if path:
            _deleted(t.sparkSession, path)


def bounded(table: DataFrame) -> DataFrame:
    """A narrow table of keys, read from files, as one side of a join: broadcast if it is counted small, else sorted and merged."""
    return F.broadcast(table) if table.count() <= BROADCAST_KEYS else table.hint("merge")


def released() -> None:
    """Give memory that a Python worker no longer uses back to the system, as workers live on for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def labels_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest of n rows that links (i, j) reach, for each."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for x in (i, j, label[i], label[j]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def arrow_column(run: Callable[[Iterator], Iterator[pa.Array]], kind: str, columns: int = 1) -> Callable[..., Column]:
    """A function of batches of Arrow arrays (tuples of them for several columns) as a function of columns.

    The columns of a row that it doesn't name stay in the JVM.
    """

    def typed(batches: Iterator) -> Iterator[pa.Array]:
        yield from run(batches)

    typed.__annotations__ = {"batches": Iterator[pa.Array] if columns == 1 else Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(typed, kind)


def fresh(table: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in table.columns}
    while name in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + re.sub("`", "``", name) + "`"


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of an edge.

    edges: columns a, b (long); any order, repeats and self links allowed. Each round passes the
    smallest label along links and then halves the way to the root by following labels; the edge and
    label tables stay in the shared folder, and only a count of changes comes to the driver.
    """
    spark = edges.sparkSession
    e = edges.select("a", "b").where("a <> b")
    both = written(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{tag}-edges")
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), f"{tag}-0")
    if label.isEmpty():
        dropped(both)
        return label
    for i in range(1, 200):
        near = label.withColumnsRenamed({"node": "b", "component": "via"})
        passed = both.join(near, "b").groupBy(F.col("a").alias("node")).agg(F.min("via").alias("via"))
        hooked = label.join(passed, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("via", "component")).alias("component"))
        # hooking the old root as well brings whole trees along, not one node at a time
        roots = hooked.groupBy(F.col("old").alias("node")).agg(F.min("component").alias("new"))
        step = hooked.join(roots, "node", "left").select("node", F.least("component", F.coalesce("new", "component")).alias("component"))
        step = written(step, f"{tag}-{i}a")
        # labels that point on: few rows beside those that have the label
        used = step.select("component").distinct()
        up = written(used.join(step.where("component <> node").select(F.col("node").alias("component"), F.col("component").alias("up")), "component"), f"{tag}-up")
        new = written(step.join(bounded(up), "component", "left").select("node", F.least("component", F.coalesce("up", "component")).alias("component")), f"{tag}-{i}")
        dropped(up)
        changed = new.join(label.withColumnRenamed("component", "old"), "node").where("component <> old").limit(1).count()
        dropped(label, step)
        label = new
        if not changed:
            dropped(both)
            return label
    raise RuntimeError("components did not settle in 200 rounds")


def table_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

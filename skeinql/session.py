"""Session set-up and table registration."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every session gets unless the caller names others. Partition counts are left to AQE.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.cbo.enabled": "true",
    "spark.sql.cbo.joinReorder.enabled": "true",
}


def session(name: str = "skeinql", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; conf has underscores for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def register(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """Register <folder>/<name>.parquet as temp views."""
    out = {}
    for name in names:
        out[name] = spark.read.parquet(f"{folder}/{name}.parquet")
        out[name].createOrReplaceTempView(name)
    return out


#: Used only where driver and executors are one process and the session names no shared folder, as in tests.
OWN_SHARED_FOLDER = "/tmp/checkpoints/skeinql"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). A cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or OWN_SHARED_FOLDER).rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder under the shared one, for this application's scratch tables."""
    return f"{shared_folder(spark)}/scratch-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove this application's scratch tables, once no result that reads them is needed any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/scratch-{spark.sparkContext.applicationId}")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

"""Event sourcing: an append-only store of streams of events, snapshots, replay to projections, and read models kept up from it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class VersionConflict(ValueError):
    """A stream has moved on since the version that an append expects."""


class EventStore:
    """Events (stream, version, kind, body, position) in files; a stream's versions follow each other from 1.

    An append is one new folder, named in the list of folders only when all of it is written. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, stream: str, body: str) -> None:
        self.spark, self.root, self.stream = spark, root.rstrip("/"), stream
        self.body = StructType.fromDDL(body)
        self.folders: list[str] = []
        self.position = 0
        self.snapshots: dict[str, tuple[int, str]] = {}

    def _schema(self) -> str:
        kinds = ", ".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in self.body)
        return f"stream {self.stream}, version long, kind string, body struct<{kinds}>, position long"

    def events(self, after: int = 0) -> DataFrame:
        """All events behind a position, which is how a reader resumes."""
        rows = self.spark.read.schema(self._schema()).parquet(*self.folders) if self.folders else self.spark.createDataFrame([], self._schema())
        return rows.where(F.col("position") > after) if after else rows

    def read(self, stream, from_version: int = 1) -> DataFrame:
        return self.events().where((F.col("stream") == stream) & (F.col("version") >= from_version))

    def append(self, rows: DataFrame, stream: str, order: Sequence[str], kind: str, expected: dict | None = None) -> int:
        """rows' own columns are the body; expected: stream -> version that it must be at. Gives the new position."""
        from pyspark.sql.window import Window

        at = self.events().groupBy("stream").agg(F.max("version").alias("_at"))
        for s, v in (expected or {}).items():
            found = at.where(F.col("stream") == s).first()
            if (found["_at"] if found else 0) != v:
                raise VersionConflict(f"stream {s} is at {found['_at'] if found else 0}, not {v}")
        n = F.row_number().over(Window.partitionBy("stream").orderBy(*order))
        new = rows.select(F.col(stream).cast(self.stream).alias("stream"), *[F.col(c) for c in order if c not in self.body.names], F.col(kind).alias("kind"), F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.body]).alias("body"), *[F.col(c) for c in order if c in self.body.names])
        new = new.withColumn("_n", n).join(at, "stream", "left").select("stream", (F.coalesce("_at", F.lit(0)) + F.col("_n")).cast("long").alias("version"), "kind", "body", F.lit(self.position + 1).cast("long").alias("position"))
        folder = f"{self.root}/e-{uuid.uuid4().hex}"
        new.write.parquet(folder)
        self.folders.append(folder)
        self.position += 1
        return self.position

    def state(self, aggregates: dict[str, tuple[str, str]], name: str = "state") -> DataFrame:
        """(stream, version, aggregates): each stream folded up to now, from the last snapshot of this name if there is one.

        aggregates: name -> (sum, count, min or max, column), as in the snapshot.
        """
        old = self.snapshots.get(name)
        return self._folded(self.events(old[0] if old else 0), aggregates, self.spark.read.parquet(old[1]) if old else None)

    @staticmethod
    def _folded(events: DataFrame, aggregates: dict[str, tuple[str, str]], before: DataFrame | None) -> DataFrame:
        how = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
        new = events.groupBy("stream").agg(F.max("version").alias("version"), *[how[f](c).alias(n) for n, (f, c) in aggregates.items()])
        if before is None:
            return new
        merge = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
        return before.unionByName(new).groupBy("stream").agg(F.max("version").alias("version"), *[merge[f](n).alias(n) for n, (f, _) in aggregates.items()])

    def snapshot(self, aggregates: dict[str, tuple[str, str]], name: str = "state") -> None:
        path = f"{self.root}/s-{uuid.uuid4().hex}"
        self.state(aggregates, name).write.parquet(path)
        self.snapshots[name] = (self.position, path)

    def retain(self, keep: Column) -> None:
        """A retention policy: events that don't meet a condition go, what snapshots have of them stays."""
        folder = f"{self.root}/e-{uuid.uuid4().hex}"
        self.events().where(F.coalesce(keep, F.lit(False))).write.parquet(folder)
        self.folders = [folder]


class ReadModel:
    """A table kept up from a store (the query side): each call takes in what came behind its position; rebuild() starts over."""

    def __init__(self, store: EventStore, root: str, project: Callable[[DataFrame | None, DataFrame], DataFrame]) -> None:
        """project: (table so far or None, new events) -> table."""
        self.store, self.root, self.project = store, root.rstrip("/"), project
        self.position, self.path = 0, None

    def catch_up(self) -> DataFrame:
        if self.path is None or self.position < self.store.position:
            before = self.store.spark.read.parquet(self.path) if self.path else None
            path = f"{self.root}/m-{uuid.uuid4().hex}"
            self.project(before, self.store.events(self.position)).write.parquet(path)
            self.path, self.position = path, self.store.position
        return self.store.spark.read.parquet(self.path)

    def rebuild(self) -> DataFrame:
        self.position, self.path = 0, None
        return self.catch_up()


class ChangeLog:
    """Changes of a table in order, with a token for each that a watcher resumes from."""

    def __init__(self, spark: SparkSession, root: str, key: Sequence[str]) -> None:
        self.spark, self.root, self.key = spark, root.rstrip("/"), list(key)
        self.folders: list[tuple[int, str]] = []

    def record(self, before: DataFrame, after: DataFrame) -> int:
        """Add what changed between two states of the table (insert, update, delete). Gives the number of the change set."""
        from skeinql.operators.temporal import change_capture

        n, folder = len(self.folders) + 1, f"{self.root}/c-{uuid.uuid4().hex}"
        rows = change_capture(before, after, self.key)
        rows.withColumn("token", F.concat(F.lpad(F.lit(n).cast("string"), 12, "0"), F.lit("-"), F.concat_ws("|", *[F.col(k).cast("string") for k in self.key]))).write.parquet(folder)
        self.folders.append((n, folder))
        return n

    def watch(self, resume_after: str | None = None, condition: Column | None = None) -> DataFrame:
        """Changes behind a token, in the order of tokens."""
        first = int(resume_after.split("-")[0]) if resume_after else 0
        paths = [p for n, p in self.folders if n >= first]
        rows = self.spark.read.parquet(*paths)
        rows = rows.where(F.col("token") > resume_after) if resume_after else rows
        return (rows if condition is None else rows.where(condition)).orderBy("token")

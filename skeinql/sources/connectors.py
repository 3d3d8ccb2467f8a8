"""Readers and writers by name, and data sources written in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Formats that need no jars; kafka, avro and jdbc work where their jars are.
FORMATS = ("parquet", "orc", "json", "csv", "text", "binaryFile")


def read(spark: SparkSession, kind: str, path: str | None = None, schema=None, **options) -> DataFrame:
    reader = spark.read.format("json" if kind == "jsonl" else kind).options(**options)
    reader = reader.schema(schema) if schema is not None else reader
    return reader.load(path) if path else reader.load()


def write(df: DataFrame, kind: str, path: str, mode: str = "errorifexists", by: Sequence[str] = (), **options) -> None:
    df.write.format("json" if kind == "jsonl" else kind).mode(mode).options(**options).partitionBy(*by).save(path)


def etl(source: DataFrame, steps: Sequence[tuple]) -> DataFrame:
    """Steps: (filter, condition), (map, {column: expression}), (select, columns), (rename, {old: new}), (aggregate, keys, {name: expression}), (join, other, keys, how), (dedup, keys), (sort, columns)."""
    for op, *arg in steps:
        if op == "filter":
            source = source.where(arg[0])
        elif op == "map":
            source = source.withColumns({c: F.expr(e) for c, e in arg[0].items()})
        elif op == "select":
            source = source.select(*arg[0])
        elif op == "rename":
            source = source.withColumnsRenamed(arg[0])
        elif op == "aggregate":
            source = source.groupBy(*arg[0]).agg(*[F.expr(e).alias(n) for n, e in arg[1].items()])
        elif op == "join":
            source = source.join(arg[0], arg[1], *arg[2:])
        elif op == "dedup":
            source = source.dropDuplicates(arg[0])
        elif op == "sort":
            source = source.orderBy(*arg[0])
        else:
            raise ValueError(f"no step {op}")
    return source


class _Range(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


class SequenceSource(DataSource):
    """Numbers and their squares, in batch (options start, end, partitions) and as a stream (option rate: rows a batch)."""

    @classmethod
    def name(cls) -> str:
        return "skein_sequence"

    def schema(self) -> str:
        return "id long, square long"

    def reader(self, schema) -> DataSourceReader:
        return _SequenceReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _SequenceStream(self.options)


def _rows(part: _Range) -> Iterator[tuple]:
    for i in range(part.start, part.end):
        yield i, i * i


class _SequenceReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.start, self.end, self.n = int(options.get("start", 0)), int(options.get("end", 100)), int(options.get("partitions", 4))

    def partitions(self) -> list[InputPartition]:
        size = max(1, -(-(self.end - self.start) // self.n))
        return [_Range(a, min(a + size, self.end)) for a in range(self.start, self.end, size)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        yield from _rows(partition)


class _SequenceStream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.rate, self.at = int(options.get("rate", 10)), 0

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        self.at += self.rate
        return {"at": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Range(start["at"], end["at"])]

    def read(self, partition: _Range) -> Iterator[tuple]:
        yield from _rows(partition)


def call_sink(name: str, function: Callable[[list], None]) -> type[DataSource]:
    """A sink of this name, to be registered, that hands rows to a function, some of a partition at a time and with retries: webhooks and others. The function must bear repeats."""

    class CallSink(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return _CallWriter(function, int(self.options.get("retries", 3)), int(self.options.get("batch", 1000)))

    return CallSink


class _CallWriter(DataSourceWriter):
    def __init__(self, function: Callable[[list], None], retries: int, batch: int) -> None:
        self.function, self.retries, self.batch = function, retries, batch

    def write(self, rows) -> WriterCommitMessage:
        while held := list(islice(rows, self.batch)):
            for n in range(self.retries + 1):
                try:
                    self.function(held)
                    break
                except Exception:
                    if n == self.retries:
                        raise
        return WriterCommitMessage()


def outbox(events: DataFrame, sent: DataFrame | None, key: str) -> DataFrame:
    """Events that have not been sent yet."""
    return events if sent is None else events.join(sent.select(key), key, "left_anti")


def with_dead_letters(df: DataFrame, valid) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the rest for a second sink."""
    ok = F.coalesce(valid, F.lit(False))
    return df.where(ok), df.where(~ok)

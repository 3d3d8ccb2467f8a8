"""How a query module registers its queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; columns are pruned by the query that reads it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register tables as temp views, for queries written in SQL."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


class Registry:
    """Collects (query, oracle) pairs of one module."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, oracle: str | None = None):
        """Decorator: register a function of (spark, sf_dir)."""

        def put(f):
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = f
            if oracle is not None:
                self.oracles[name] = oracle
            return f

        return put

    def sql(self, name: str, tables: str, spark_sql: str, oracle: str | None = None) -> None:
        """Register SQL text; without an oracle of its own the same text runs on DuckDB."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            views(spark, sf_dir, *tables.split())
            return spark.sql(spark_sql)

        self.add(name, spark_sql if oracle is None else oracle)(run)

"""Materialised views, kept up by merging deltas and used for questions they can answer, and a cache of query results."""

from __future__ import annotations

import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class AggregateView:
    """Sums and counts of a table by some keys. Deltas of added and removed rows are merged without reading the table."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], sums: Sequence[str]) -> None:
        self.spark, self.path, self.keys, self.sums = spark, path.rstrip("/"), list(keys), list(sums)
        self.current: str | None = None

    def _totals(self, rows: DataFrame, sign: int) -> DataFrame:
        return rows.groupBy(*self.keys).agg(F.sum(F.lit(sign)).cast("long").alias("n"), *[F.sum(F.col(c) * sign).alias(c) for c in self.sums])

    def _put(self, rows: DataFrame) -> None:
        new = f"{self.path}/{uuid.uuid4().hex}"
        rows.write.parquet(new)
        self.current = new

    def refresh(self, base: DataFrame) -> None:
        """Complete: from the table."""
        self._put(self._totals(base, 1))

    def apply(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Fast: groups of which no row is left go."""
        parts = [self.read(with_counts=True)] + [self._totals(r, s) for r, s in ((added, 1), (removed, -1)) if r is not None]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        self._put(rows.groupBy(*self.keys).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in self.sums]).where("n > 0"))

    def read(self, with_counts: bool = True) -> DataFrame:
        rows = self.spark.read.parquet(self.current)
        return rows if with_counts else rows.drop("n")

    def answer(self, keys: Sequence[str], sums: Sequence[str]) -> DataFrame | None:
        """A coarser question from the view, or None if the view doesn't have what it asks for."""
        if not set(keys) <= set(self.keys) or not set(sums) <= set(self.sums):
            return None
        return self.read().groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums])


@dataclass(frozen=True)
class RefreshPolicy:
    """When a view is brought up to date: on every change (commit), when asked (demand), or when it is read and older than so many seconds (periodic)."""

    kind: str = "demand"
    seconds: float = 0.0

    def __post_init__(self) -> None:
        if self.kind not in ("commit", "demand", "periodic"):
            raise ValueError(f"no refresh policy {self.kind}")


class ViewStore:
    """Aggregate views of base tables. Questions are answered from the smallest view that holds all they ask for, else from the table."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock
        self._views: dict[str, tuple[str, AggregateView, RefreshPolicy]] = {}
        self._base: dict[str, Callable[[], DataFrame]] = {}
        self._state: dict[str, list] = {}  # view -> [time of refresh, whether stale, rows]

    def base(self, name: str, read: Callable[[], DataFrame]) -> None:
        self._base[name] = read

    def create(self, view: str, base: str, keys: Sequence[str], sums: Sequence[str], policy: RefreshPolicy = RefreshPolicy()) -> None:
        self._views[view] = (base, AggregateView(self.spark, f"{self.root}/{view}", keys, sums), policy)
        self.refresh(view)

    def drop(self, view: str) -> None:
        del self._views[view], self._state[view]

    def refresh(self, view: str) -> None:
        base, v, _ = self._views[view]
        v.refresh(self._base[base]())
        self._state[view] = [self.clock(), False, v.read().count()]

    def changed(self, base: str, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Tell of rows that were added to or removed from a table: views kept on commit merge them, others become stale."""
        for name, (b, v, policy) in self._views.items():
            if b != base:
                continue
            if policy.kind == "commit":
                v.apply(added, removed)
                self._state[name] = [self.clock(), False, v.read().count()]
            else:
                self._state[name][1] = True

    def _usable(self, name: str) -> bool:
        at, stale, _ = self._state[name]
        policy = self._views[name][2]
        if stale and policy.kind == "periodic" and self.clock() - at > policy.seconds:
            self.refresh(name)
            return True
        return not stale

    def ask(self, base: str, keys: Sequence[str], aggregates: dict[str, tuple[str, str]], where: Column | str | None = None, filtered: Sequence[str] = ()) -> tuple[DataFrame, str | None]:
        """(result, name of the view it comes from). aggregates: name -> (sum, count or avg, column); filtered: columns that where reads."""
        sums = {c for how, c in aggregates.values() if how != "count"}
        fits = [n for n, (b, v, _) in self._views.items() if b == base and {*keys, *filtered} <= set(v.keys) and sums <= set(v.sums) and (where is None or filtered) and self._usable(n)]
        name = min(fits, key=lambda n: self._state[n][2], default=None)
        if name is None:
            rows = self._base[base]()
            agg = {"sum": F.sum, "avg": F.avg, "count": lambda c: F.count(F.lit(1))}
            made = [agg[how](c).alias(n) for n, (how, c) in aggregates.items()]
        else:
            rows = self._views[name][1].read()
            agg = {"sum": F.sum, "avg": lambda c: F.sum(c) / F.sum("n"), "count": lambda c: F.sum("n")}
            made = [agg[how](c).alias(n) for n, (how, c) in aggregates.items()]
        rows = rows if where is None else rows.where(where)
        return rows.groupBy(*keys).agg(*made), name


class ResultCache:
    """Persisted results by what a query means: least recently used and outdated ones go, and those of a changed table.

    Two texts share a result if their analysed plans do, so literals, names and what a view now stands for
    all count; files that change in place must be told by changed().
    """

    def __init__(self, entries: int = 100, seconds: float = 300.0, clock: Callable[[], float] = time.time) -> None:
        self.entries, self.seconds, self.clock = entries, seconds, clock
        self._held: OrderedDict[int, tuple[float, frozenset[str], DataFrame, DataFrame]] = OrderedDict()
        self._n = 0
        self.hits = self.misses = 0

    def get(self, spark: SparkSession, sql: str, tables: Sequence[str]) -> DataFrame:
        asked = spark.sql(sql)
        found = next((k for k, (_, t, own, _) in self._held.items() if t == frozenset(tables) and own.semanticHash() == asked.semanticHash() and own.sameSemantics(asked) and own.columns == asked.columns), None)
        if found is not None and self.clock() - self._held[found][0] <= self.seconds:
            self.hits += 1
            self._held.move_to_end(found)
            return self._held[found][3]
        if found is not None:
            self._drop(found)
        self.misses += 1
        self._n += 1
        self._held[self._n] = (self.clock(), frozenset(tables), asked, asked.persist())
        while len(self._held) > self.entries:
            self._drop(next(iter(self._held)))
        return self._held[self._n][3]

    def _drop(self, key: int) -> None:
        found = self._held.pop(key, None)
        if found:
            found[3].unpersist()

    def changed(self, table: str) -> None:
        for key in [k for k, (_, t, *_) in self._held.items() if table in t]:
            self._drop(key)

"""Columns kept in executors' memory: population by priority, eviction of what is cold, and shared fragments of plans."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame


def estimated_bytes(df: DataFrame) -> int:
    """What the optimizer expects a table to take."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


class ColumnStore:
    """Some columns of tables as persisted, compressed column batches beside the files they come from.

    Population is asked for with a priority and done in populate(), the most urgent first, as long as the
    estimated sizes fit the capacity; then columns that have been used least recently go, if they are less
    urgent. Scans use memory for the columns that are there and files for the others. What is persisted may
    spill to disk and is computed again when an executor is lost.
    """

    def __init__(self, capacity: int, clock: Callable[[], float] = time.monotonic) -> None:
        self.capacity, self.clock = capacity, clock
        self._tables: dict[str, DataFrame] = {}
        self._wanted: list[tuple[int, str, tuple[str, ...]]] = []
        self._held: dict[tuple[str, tuple[str, ...]], dict] = {}

    def register(self, name: str, table: DataFrame) -> None:
        self._tables[name] = table

    def want(self, name: str, columns: Sequence[str], priority: int = 0) -> None:
        self._wanted.append((priority, name, tuple(columns)))

    def used(self) -> int:
        return sum(h["bytes"] for h in self._held.values())

    def populate(self) -> list[tuple[str, tuple[str, ...]]]:
        """Load what is wanted, in order of priority. Gives what was loaded."""
        done = []
        for priority, name, columns in sorted(self._wanted, key=lambda w: -w[0]):
            if (name, columns) in self._held:
                continue
            rows = self._tables[name].select(*columns)
            size = estimated_bytes(rows)
            if size <= self.capacity and self._make_room(size, priority):
                kept = rows.persist(StorageLevel.MEMORY_AND_DISK)
                kept.count()
                self._held[(name, columns)] = {"rows": kept, "bytes": size, "priority": priority, "at": self.clock(), "uses": 0}
                done.append((name, columns))
        self._wanted = []
        return done

    def _make_room(self, size: int, priority: int) -> bool:
        cold = sorted((k for k, h in self._held.items() if h["priority"] <= priority), key=lambda k: (self._held[k]["priority"], self._held[k]["at"]))
        free, gone = self.capacity - self.used(), []
        for k in cold:
            if free >= size:
                break
            free += self._held[k]["bytes"]
            gone.append(k)
        if free < size:
            return False
        for k in gone:
            self.evict(*k)
        return True

    def evict(self, name: str, columns: Sequence[str]) -> None:
        self._held.pop((name, tuple(columns)))["rows"].unpersist()

    def evict_cold(self, seconds: float) -> int:
        """Drop what has not been used for so long. Gives how many."""
        old = [k for k, h in self._held.items() if self.clock() - h["at"] > seconds]
        for k in old:
            self.evict(*k)
        return len(old)

    def scan(self, name: str, columns: Sequence[str], condition: Column | str | None = None) -> tuple[DataFrame, bool]:
        """(rows, whether they come from memory)."""
        need = set(columns)
        fits = [k for k in self._held if k[0] == name and need <= set(k[1])]
        if fits:
            best = min(fits, key=lambda k: self._held[k]["bytes"])
            self._held[best] |= {"at": self.clock(), "uses": self._held[best]["uses"] + 1}
        rows = self._held[best]["rows"] if fits else self._tables[name]
        rows = rows if condition is None else rows.where(condition)
        return rows.select(*columns), bool(fits)

    def status(self) -> dict[tuple[str, tuple[str, ...]], tuple[int, int]]:
        """(table, columns) -> (bytes, uses)."""
        return {k: (h["bytes"], h["uses"]) for k, h in self._held.items()}


class FragmentCache:
    """Parts of queries that several queries share: asked for twice, a fragment is persisted, and equal fragments are one."""

    def __init__(self, entries: int = 20) -> None:
        self.entries, self._seen, self.hits = entries, [], 0

    def shared(self, fragment: DataFrame) -> DataFrame:
        """The fragment itself the first time, a persisted one from the second time on."""
        for k, (known, kept) in enumerate(self._seen):
            if known.semanticHash() == fragment.semanticHash() and known.sameSemantics(fragment):
                self.hits += 1
                kept = kept or known.persist()
                self._seen.append(self._seen.pop(k)[:1] + (kept,))
                return kept
        self._seen.append((fragment, None))
        if len(self._seen) > self.entries:
            _, old = self._seen.pop(0)
            if old is not None:
                old.unpersist()
        return fragment


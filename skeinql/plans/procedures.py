"""Cursors, bulk statements and packages for procedures of a catalog.

Control flow (IF, CASE, LOOP, WHILE, REPEAT, FOR, handlers) is Spark's own SQL scripting; what is here is what
scripts over changing tables need beside it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row

from skeinql.plans.catalog import Catalog


class CursorError(RuntimeError):
    """A cursor that is used while it is closed, or opened twice."""


class Cursor:
    """The rows of a query one after another, or some at a time; a partition at a time is on the driver."""

    def __init__(self, query: Callable[..., DataFrame]) -> None:
        self.query = query
        self._rows: Iterator[Row] | None = None
        self.row_count, self.found = 0, None

    @property
    def is_open(self) -> bool:
        return self._rows is not None

    def open(self, *args) -> "Cursor":
        if self.is_open:
            raise CursorError("the cursor is open already")
        self._rows, self.row_count, self.found = self.query(*args).toLocalIterator(), 0, None
        return self

    def fetch(self) -> Row | None:
        """The next row, or None when there is none."""
        some = self.fetch_bulk(1)
        return some[0] if some else None

    def fetch_bulk(self, limit: int) -> list[Row]:
        """The next rows, at most so many (BULK COLLECT ... LIMIT)."""
        if self._rows is None:
            raise CursorError("the cursor is not open")
        out = []
        for row in self._rows:
            out.append(row)
            if len(out) == limit:
                break
        self.row_count += len(out)
        self.found = bool(out)
        return out

    def close(self) -> None:
        if self._rows is None:
            raise CursorError("the cursor is not open")
        self._rows = None

    def __iter__(self) -> Iterator[Row]:
        """A cursor loop: opens, gives all rows and closes."""
        self.open()
        try:
            while (row := self.fetch()) is not None:
                yield row
        finally:
            self.close()


def forall(catalog: Catalog, name: str, event: str, rows: DataFrame, key: Sequence[str]) -> int:
    """One statement for many rows (FORALL): insert, update or delete by key. Gives the number of rows."""
    n = rows.count()
    if event == "insert":
        catalog.insert(name, rows)
    elif event == "update":
        now = catalog.table(name)
        rest = [c for c in now.columns if c not in rows.columns]
        own = now.select(*key, *rest)
        catalog.merge(name, rows.join(own, list(key)).select(now.columns), key)
    elif event == "delete":
        now = catalog.table(name)
        gone = rows.select(*key).distinct()
        hit = now.join(gone, list(key), "left_semi").select(now.columns)
        catalog._change(name, now.join(gone, list(key), "left_anti").select(now.columns), "delete", hit, gone=hit)
    else:
        raise ValueError(f"no bulk statement {event}")
    return n


class Package:
    """Procedures and state under one name; only what is public can be called from outside."""

    def __init__(self, catalog: Catalog, name: str, **state) -> None:
        self.catalog, self.name, self.state = catalog, name, state
        self._own: dict[str, Callable] = {}
        self._public: set[str] = set()

    def procedure(self, name: str, f: Callable, public: bool = True) -> None:
        """f gets the package and the arguments."""
        self._own[name] = f
        if public:
            self._public.add(name)
            self.catalog.create_procedure(f"{self.name}.{name}", lambda cat, *args, **named: f(self, *args, **named))

    def run(self, name: str, *args, **named):
        """From inside of the package: private procedures as well."""
        return self._own[name](self, *args, **named)

    def call(self, name: str, *args, **named):
        if name not in self._public:
            raise PermissionError(f"{self.name}.{name} is not public")
        return self.run(name, *args, **named)

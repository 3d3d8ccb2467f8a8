"""A fluent query builder with named filter operators, and hints and plan reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operator name -> condition of a column and an argument.
FILTERS = {
    "Eq": lambda c, v: c == v, "Ne": lambda c, v: c != v, "Gt": lambda c, v: c > v, "Gte": lambda c, v: c >= v, "Lt": lambda c, v: c < v, "Lte": lambda c, v: c <= v,
    "In": lambda c, v: c.isin(list(v)), "NotIn": lambda c, v: ~c.isin(list(v)), "Like": lambda c, v: c.like(v), "ILike": lambda c, v: c.ilike(v), "IsNull": lambda c, v: c.isNull() if v else c.isNotNull(),
    "Between": lambda c, v: c.between(*v), "Contains": lambda c, v: c.contains(v), "StartsWith": lambda c, v: c.startswith(v), "EndsWith": lambda c, v: c.endswith(v), "Regex": lambda c, v: c.rlike(v),
}

AGGREGATES = {"Count": F.count, "Sum": F.sum, "Avg": F.avg, "Min": F.min, "Max": F.max, "StdDev": F.stddev_samp, "Variance": F.var_samp, "CountDistinct": F.count_distinct}

#: Hint names of other engines -> Spark's; others are ignored.
HINTS = {"USE_HASH": "shuffle_hash", "USE_MERGE": "merge", "USE_NL": "shuffle_replicate_nl", "BROADCAST": "broadcast", "PARALLEL": "repartition"}


def condition(spec: dict) -> Column:
    """{'and': [...]}, {'or': [...]}, {'not': {...}} or {'field', 'op', 'value'}."""
    if "and" in spec or "or" in spec:
        (key, parts), out = next(iter(spec.items())), None
        for p in parts:
            out = condition(p) if out is None else out & condition(p) if key == "and" else out | condition(p)
        return out
    if "not" in spec:
        return ~condition(spec["not"])
    return FILTERS[spec["op"]](F.col(spec["field"]), spec.get("value", True))


class Query:
    """Steps are put in order when it runs: joins, filter, groups, having, select, order, page."""

    def __init__(self, df: DataFrame) -> None:
        self._df, self._where, self._select, self._order, self._group, self._aggs, self._having, self._limit, self._offset, self._distinct = df, None, [], [], [], [], None, None, None, False

    def join(self, other: DataFrame, on, how: str = "inner", hint: str | None = None) -> "Query":
        """hint: of a join, or PARALLEL(n), which deals the other side out to n partitions by the join's columns."""
        name, _, degree = (hint or "").upper().rstrip(")").partition("(")
        spark_hint = HINTS.get(name)
        if spark_hint == "repartition":
            by = [on] if isinstance(on, str) else [c for c in on if isinstance(c, str)] if isinstance(on, (list, tuple)) else []
            other = other.repartition(int(degree), *by) if degree else other.repartition(*by) if by else other
        elif spark_hint:
            other = other.hint(spark_hint)
        self._df = self._df.join(other, on, how)
        return self

    def where(self, spec: dict | Column) -> "Query":
        c = condition(spec) if isinstance(spec, dict) else spec
        self._where = c if self._where is None else self._where & c
        return self

    def select(self, *columns) -> "Query":
        self._select = list(columns)
        return self

    def group(self, *columns: str, **aggregates: tuple[str, str]) -> "Query":
        self._group, self._aggs = list(columns), [AGGREGATES[f](c if c != "*" else F.lit(1)).alias(n) for n, (f, c) in aggregates.items()]
        return self

    def having(self, spec: dict) -> "Query":
        self._having = condition(spec)
        return self

    def order(self, *columns: str) -> "Query":
        """Names; a leading - is descending. Nulls come last."""
        self._order = [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in columns]
        return self

    def page(self, limit: int | None = None, offset: int | None = None) -> "Query":
        self._limit, self._offset = limit, offset
        return self

    def after(self, cursor: dict[str, object]) -> "Query":
        """Rows behind a cursor (name -> value, in the order of the sort; a leading - is descending): pages without counting off rows. Nulls come last."""
        c, same = F.lit(False), F.lit(True)
        for name, value in cursor.items():
            col, v = F.col(name.lstrip("-")), value if isinstance(value, Column) else F.lit(value)
            beyond = (col < v) if name.startswith("-") else (col > v)
            c, same = c | (same & F.coalesce(beyond, v.isNotNull() & col.isNull())), same & col.eqNullSafe(v)
        return self.where(c)

    def distinct(self) -> "Query":
        self._distinct = True
        return self

    def run(self) -> DataFrame:
        df = self._df if self._where is None else self._df.where(self._where)
        if self._aggs:
            df = df.groupBy(*self._group).agg(*self._aggs)
            df = df if self._having is None else df.where(self._having)
        df = df.select(*self._select) if self._select else df
        df = df.distinct() if self._distinct else df
        df = df.orderBy(*self._order) if self._order else df
        df = df.offset(self._offset) if self._offset else df
        return df if self._limit is None else df.limit(self._limit)


def plan(df: DataFrame) -> str:
    """The physical plan as text."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def plan_report(df: DataFrame) -> dict[str, int]:
    """How many scans, exchanges, joins of each kind, sorts, windows and Python nodes a plan has."""
    import re

    head = plan(df).split("\n\n")[0]
    names = re.findall(r"^[\s:+\-*|]*(?:\* )?([A-Z]\w+)", head, re.M)
    return {n: names.count(n) for n in sorted(set(names))}


def pushed_filters(df: DataFrame) -> list[str]:
    import re

    return re.findall(r"PushedFilters: \[([^\]]*)\]", plan(df))

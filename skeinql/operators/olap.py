"""OLAP cubes over a fact table with dimension hierarchies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Cube:
    """Dimensions, measures (name -> aggregate) and hierarchies (name -> levels, coarse to fine) over facts."""

    facts: DataFrame
    dimensions: Sequence[str]
    measures: dict[str, Column]
    hierarchies: dict[str, Sequence[str]] = field(default_factory=dict)

    def _agg(self, grouped) -> DataFrame:
        return grouped.agg(*[c.alias(n) for n, c in self.measures.items()])

    def by(self, *dimensions: str) -> DataFrame:
        return self._agg(self.facts.groupBy(*dimensions))

    def cube(self, *dimensions: str) -> DataFrame:
        """All groupings; grouping_id tells a null value from a dimension that is left out."""
        return self.facts.cube(*(dimensions or self.dimensions)).agg(F.grouping_id().alias("grouping_id"), *[c.alias(n) for n, c in self.measures.items()])

    def rollup(self, *dimensions: str) -> DataFrame:
        return self.facts.rollup(*(dimensions or self.dimensions)).agg(F.grouping_id().alias("grouping_id"), *[c.alias(n) for n, c in self.measures.items()])

    def grouping_sets(self, *sets: Sequence[str]) -> DataFrame:
        every = list(dict.fromkeys(c for s in sets for c in s))
        return self.facts.groupingSets([list(s) for s in sets], *every).agg(*[c.alias(n) for n, c in self.measures.items()])

    def slice(self, dimension: str, value) -> "Cube":
        return Cube(self.facts.where(F.col(dimension) == value), [d for d in self.dimensions if d != dimension], self.measures, self.hierarchies)

    def dice(self, **values) -> "Cube":
        cond = F.lit(True)
        for d, v in values.items():
            cond = cond & (F.col(d).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(d) == v)
        return Cube(self.facts.where(cond), self.dimensions, self.measures, self.hierarchies)

    def drill_down(self, hierarchy: str, level: str) -> DataFrame:
        """Measures by the levels down to the one below."""
        levels = list(self.hierarchies[hierarchy])
        return self.by(*levels[: levels.index(level) + 2])

    def roll_up(self, hierarchy: str, level: str) -> DataFrame:
        """Measures by the levels above."""
        levels = list(self.hierarchies[hierarchy])
        return self.by(*levels[: levels.index(level)])

    def pivot(self, rows: Sequence[str], column: str, measure: str, values: Sequence | None = None) -> DataFrame:
        """One column for each value. Naming the values saves the pass that finds them."""
        return self.facts.groupBy(*rows).pivot(column, values).agg(self.measures[measure])


class StarSchema:
    """A fact table and its dimensions: questions name attributes as dimension.attribute, and only dimensions they name are joined."""

    def __init__(self, fact: DataFrame) -> None:
        self.fact = fact
        self.dimensions: dict[str, tuple[DataFrame, str, str]] = {}

    def dimension(self, name: str, table: DataFrame, fact_key: str, key: str) -> "StarSchema":
        """key must be unique in the dimension."""
        self.dimensions[name] = (table, fact_key, key)
        return self

    def query(self, by: Sequence[str], where: str | None = None, **measures: Column) -> DataFrame:
        """Measures by attributes; where is SQL over dimension.attribute and fact columns."""
        import re

        named = set(re.findall(r"\b(\w+)\.\w+", " ".join([*by, where or ""]))) & set(self.dimensions)
        rows = self.fact.alias("fact")
        for n in sorted(named):
            table, fact_key, key = self.dimensions[n]
            rows = rows.join(table.alias(n), F.col(f"fact.{fact_key}") == F.col(f"{n}.{key}"), "left")
        rows = rows if where is None else rows.where(where)
        return rows.groupBy(*[F.col(a).alias(a.replace(".", "_")) for a in by]).agg(*[m.alias(n) for n, m in measures.items()])

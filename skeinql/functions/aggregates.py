"""Aggregates of a user's own: a state is made for each group of a partition, states are merged, and the last one is finished."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class UserAggregate:
    """state: its columns as DDL; accumulate: (state, values of a batch) -> state; merge: (state, state) -> state; finish: state -> result."""

    state: str
    initial: Callable[[], tuple]
    accumulate: Callable[[tuple, pd.Series], tuple]
    merge: Callable[[tuple, tuple], tuple]
    finish: Callable[[tuple], object]
    result: str
    #: Whether equal rows always give an equal result; others must not be computed again, so their states are written first.
    deterministic: bool = True


def aggregate(df: DataFrame, keys: Sequence[str], value: str, how: UserAggregate, name: str) -> DataFrame:
    """(keys, name). Only states are shuffled, one for each group of each partition."""
    fields = [f.name for f in StructType.fromDDL(how.state)]
    own = df.select(*keys, value)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[tuple, tuple] = {}
        for pdf in batches:
            for k, rows in pdf.groupby(list(keys), dropna=False, sort=False):
                k = tuple(None if pd.isna(x) else x for x in k)
                states[k] = how.accumulate(states.get(k, how.initial()), rows[value])
            if len(states) > 100_000:  # hand on what there is, so that a task never holds all groups
                yield pd.DataFrame([(*k, *s) for k, s in states.items()], columns=[*keys, *fields])
                states = {}
        yield pd.DataFrame([(*k, *s) for k, s in states.items()], columns=[*keys, *fields])

    def end(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf[fields].itertuples(index=False, name=None))
        state = rows[0]
        for other in rows[1:]:
            state = how.merge(state, other)
        return pd.DataFrame([(*(pdf[c].iloc[0] for c in keys), how.finish(state))], columns=[*keys, name])

    states = own.mapInPandas(begin, f"{kinds}, {how.state}")
    if not how.deterministic:
        from skeinql.session import scratch

        path = scratch(df.sparkSession, "states")
        states.write.parquet(path)
        states = df.sparkSession.read.parquet(path)
    return states.groupBy(*keys).applyInPandas(end, f"{kinds}, `{name}` {how.result}")

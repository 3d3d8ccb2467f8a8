"""Complex event patterns: sequences, alternatives, quantifiers and absence, over each key's ordered events.

Every event gets a letter for the set of conditions it meets (native columns), a key's letters in order are
a string, and the pattern is a regular expression over it, in which a step stands for all letters whose set
has its condition. A time limit bounds the string that a match may take from, so a greedy step takes what
fits. Measures are taken from the matched events.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Letters begin here; the 256 characters from it on are letters in no regular expression's syntax.
BASE = 0x4E00


@dataclass(frozen=True)
class Step:
    """A named condition with a quantifier: 1, ?, *, +, or (least, most)."""

    name: str
    condition: Column
    quantifier: str | tuple[int, int | None] = ""
    negated: bool = False


def followed_by(*steps: Step) -> list:
    """Steps with any events between."""
    out: list = []
    for s in steps:
        out += [s, None]
    return out[:-1]


def any_of(*steps: Step) -> tuple:
    return steps


def _regex(pattern: Sequence, bit: dict[str, int]) -> str:
    """The pattern over letters chr(BASE + set of conditions)."""
    sets = range(1 << len(bit))
    some = lambda test: "[" + "".join(re.escape(chr(BASE + m)) for m in sets if test(m)) + "]"
    out = ""
    for item in pattern:
        if item is None:
            out += ".*?"
            continue
        steps = item if isinstance(item, tuple) else (item,)
        mask = sum({bit[s.name]: 1 << bit[s.name] for s in steps}.values())
        group = some(lambda m: not m & mask) if steps[0].negated else some(lambda m: m & mask)
        q = steps[0].quantifier
        out += group + (f"{{{q[0]},{'' if q[1] is None else q[1]}}}" if isinstance(q, tuple) else q)
    return out


def match(df: DataFrame, key: Sequence[str], ts: str, pattern: Sequence, within_seconds: float | None = None, skip: str = "past_last", value: str | None = None, tie: Sequence[str] = (), each_seconds: float | None = None) -> DataFrame:
    """(key, start, end, events, total, mean, least, most, first, last): the matches of each key, in order, and measures of value.

    skip: past_last (matches share no events), to_next (the next match may begin one event later), to_last (at
    the last event of a match) or no_prefix (all beginnings, of matches with one end the longest).
    each_seconds: how far apart neighbouring events of a match may be, beside within_seconds for all of it.
    An event may take any step whose condition it meets. Events of one time are in the order of the tie
    columns. A match is the first that the pattern finds from its first event on, greedy steps taking as much
    as the time limits leave. At most 8 conditions.
    """
    steps = {s.name: s for item in pattern if item is not None for s in (item if isinstance(item, tuple) else (item,))}
    if len(steps) > 8:
        raise ValueError("a pattern has 8 conditions at most")
    bit = {name: k for k, name in enumerate(steps)}
    mark = sum((F.when(F.coalesce(s.condition, F.lit(False)), 1 << bit[n]).otherwise(0) for n, s in steps.items()), F.lit(0))
    expr = re.compile(_regex(pattern, bit), re.DOTALL)
    rows = df.select(*key, F.col(ts).alias("_t"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(tie)], mark.cast("int").alias("_m"), (F.col(value) if value else F.lit(0.0)).cast("double").alias("_v"))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in key)
    order = ["_t", *(f"_o{i}" for i in range(len(tie)))]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        text, found, at = "".join(chr(BASE + m) for m in pdf["_m"]), [], 0
        ends = [len(text)] * len(text) if within_seconds is None else pdf["_t"].searchsorted(pdf["_t"] + pd.Timedelta(seconds=within_seconds), "right").tolist()
        if each_seconds is not None and len(text):
            # a match ends before the first gap that is too long
            wide = (pdf["_t"].shift(-1) - pdf["_t"] > pd.Timedelta(seconds=each_seconds)).tolist()
            stop = len(text)
            for i in range(len(text) - 1, -1, -1):
                stop = i + 1 if wide[i] else stop
                ends[i] = min(ends[i], stop)
        v = pdf["_v"].to_numpy()
        seen: set[int] = set()
        while at < len(text):
            m = expr.match(text, at, ends[at])
            if not m or m.end() == at:
                at += 1
                continue
            b = m.end() - 1
            own = v[at : b + 1]
            if skip != "no_prefix" or b not in seen:
                found.append((*(pdf[c][0] for c in key), pdf["_t"][at], pdf["_t"][b], b - at + 1, float(own.sum()), float(own.mean()), float(own.min()), float(own.max()), float(own[0]), float(own[-1])))
            seen.add(b)
            at = m.end() if skip == "past_last" else max(b, at + 1) if skip == "to_last" else at + 1
        return pd.DataFrame(found, columns=[*key, "start", "end", "events", "total", "mean", "least", "most", "first", "last"])

    t = df.schema[ts].dataType.simpleString()
    return rows.groupBy(*key).applyInPandas(run, f"{kinds}, start {t}, end {t}, events int, total double, mean double, least double, most double, first double, last double")


def sequence(df: DataFrame, key: Sequence[str], ts: str, first: Column, second: Column, within: str) -> DataFrame:
    """Rows that meet the second condition after one that met the first, within an interval: native windows only."""
    w = Window.partitionBy(*key).orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.when(first, F.col(ts))).over(w)
    return df.withColumn("first_at", before).where(second & F.col("first_at").isNotNull() & (F.col(ts) <= F.col("first_at") + F.expr(f"INTERVAL {within}")))


def absent_after(df: DataFrame, key: Sequence[str], ts: str, first: Column, second: Column, within: str) -> DataFrame:
    """Rows that meet the first condition and are not followed by the second within an interval."""
    w = Window.partitionBy(*key).orderBy(ts).rowsBetween(1, Window.unboundedFollowing)
    later = F.min(F.when(second, F.col(ts))).over(w)
    return df.withColumn("_l", later).where(first & (F.col("_l").isNull() | (F.col("_l") > F.col(ts) + F.expr(f"INTERVAL {within}")))).drop("_l")

"""Mix sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Sources get shares of a budget of words in proportion to their weights; none gets more than
``max_epochs`` times what it has, and what is cut off goes to the others by weight until nothing is
cut off. Each round adds up, over all sources, the sizes of those that are full at the present level and
the weights of the others, which gives the next level; it ends when no more become full. Only such sums
come to the driver, and sources are numbered by ranges, so there may be any number of them.

A source's target is taken as whole repetitions of all its documents and one more of those with the
smallest seeded hash of doc_id, up to the document at which the words taken come nearest to the target.
The cut is found with a histogram of the hash (4096 cells a source) and a window over the one cell in
which it lies, so no source is gathered in one task. The result is a plan with a row for each source;
applying it to a document needs only its source and doc_id.

Defined results: a null text has size 0; a null source is a source of its own, ranked last; rows with
the same doc_id are taken alike (all or none of the fractional repetition); null doc_ids likewise; an
empty table or one without words takes nothing; extra columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinql.llm.common import BROADCAST_KEYS, dropped, table_of, written

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET_SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = 20_240
CELL_BITS = 12


def text_size(text: Column) -> Column:
    """Number of maximal runs of characters that are not white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """A non-null key for a source, null's own among them."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _hash(doc_id: Column, seed: int) -> Column:
    return F.xxhash64(doc_id.cast("string"), F.lit(seed))


def _cell(h: Column) -> Column:
    """The cells of the hash in ascending order of the (signed) hash."""
    return F.shiftright(h, 64 - CELL_BITS).cast("int")


def numbered(sizes: DataFrame) -> DataFrame:
    """sizes with n: the place of each row by source (code point order, null last), from 0. Rows are sorted by ranges, not in one task."""
    order = F.col("source").asc_nulls_last()
    dealt = written(sizes.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))  # a row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    return dealt.withColumn("part", part).join(F.broadcast(base), "part").withColumn("n", F.col("base") + inside).drop("part", "base", "at")


def water_level(ranked: DataFrame, weights: Sequence[float], budget_share: float, max_epochs: float) -> float:
    """The words for a unit of weight at which all sources together take the budget, none above its cap. ranked: source_size, w."""
    level, full = 0.0, -1
    while True:
        capped = F.col("source_size") * F.lit(max_epochs) <= F.col("w") * F.lit(level)
        sums = [F.count_if(capped), F.sum("source_size"), F.sum(F.when(capped, F.col("source_size")))]
        # weights are counted, so that the order of adding up doesn't matter
        found = ranked.agg(*sums, *[F.count_if(~capped & (F.col("w") == w)) for w in dict.fromkeys(map(float, weights))]).first()
        if found[0] == full:
            return level
        full, rest = found[0], sum(w * n for w, n in zip(dict.fromkeys(map(float, weights)), found[3:]))
        if not rest:
            return math.inf
        level = ((found[1] or 0) * budget_share - (found[2] or 0) * max_epochs) / rest


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget_share: float = BUDGET_SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(key, source_size, target) from (key, source, source_size), one row a source."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = written(numbered(sizes).withColumn("w", F.get(cycle, F.pmod("n", F.lit(len(weights))).cast("int"))), "mix-ranked")
    level = water_level(ranked, weights, budget_share, max_epochs)
    cap = F.col("source_size") * F.lit(float(max_epochs))
    return ranked.select("key", "source_size", F.least(cap, F.col("w") * F.lit(level)).alias("target"))


def sized(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, key, size, h) of every document."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _key(F.col(source_col)).alias("key"), text_size(F.col(text_col)).alias("size"), _hash(F.col(id_col), seed).alias("h")
    )


def mixing_plan(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget_share: float = BUDGET_SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row a source: key, source_size, target, whole, cut (the largest hash that is taken once more, or null).

    sizes: a table that sized() made, written first as it is read three times.
    """
    per_source = sizes.groupBy("key").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))
    goal = targets(per_source, weights, budget_share, max_epochs).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = written(goal.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")), "mix-goal")
    near = F.broadcast(goal) if goal.count() <= BROADCAST_KEYS else goal
    cells = sizes.groupBy("key", _cell(F.col("h")).alias("cell")).agg(F.sum("size").alias("size"))
    up_to = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = cells.withColumn("end", F.sum("size").over(up_to)).join(near.select("key", "left"), "key")
    edge = edge.where("left > 0 AND end - size <= left AND end > left").select("key", "cell", "left", (F.col("end") - F.col("size")).alias("start"))
    edge = written(edge, "mix-edge")  # at most a row a source
    near_edge = F.broadcast(edge) if edge.count() <= BROADCAST_KEYS else edge
    inside = sizes.withColumn("cell", _cell(F.col("h"))).join(near_edge, ["key", "cell"])
    same = inside.groupBy("key", "h").agg(F.sum("size").alias("size"), F.first("left").alias("left"), F.first("start").alias("start"))
    walk = Window.partitionBy("key").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = same.withColumn("end", F.col("start") + F.sum("size").over(walk)).where(F.col("end") - F.col("size") / 2 <= F.col("left"))
    last = taken.groupBy("key").agg(F.max("h").alias("inner_cut"))
    # where no document of the cell fits, the cut is just below the cell
    floor = F.shiftleft(F.col("cell").cast("long"), 64 - CELL_BITS)
    cut = edge.select("key", "cell").join(last, "key", "left").select("key", F.coalesce("inner_cut", F.when(floor > F.lit(-(2**63)), floor - 1)).alias("cut"))
    return goal.join(cut, "key", "left").select("key", "source_size", "target", "whole", "cut")


def copies(docs: DataFrame, plan: DataFrame, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with the columns source_size, target and copies (how often the mix takes the document)."""
    plan = plan.withColumnsRenamed({c: f"_mix_{c}" for c in plan.columns})
    near = F.broadcast(plan) if plan.count() <= BROADCAST_KEYS else plan
    once_more = F.coalesce(_hash(F.col(id_col), seed) <= F.col("_mix_cut"), F.lit(False))
    out = docs.join(near, _key(F.col(source_col)) == F.col("_mix_key"))
    return out.withColumns({"source_size": F.col("_mix_source_size"), "target": F.col("_mix_target"), "copies": F.col("_mix_whole") + once_more.cast("long")}).drop(*plan.columns)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget_share: float = BUDGET_SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document; taken: words that the mix takes."""
    sizes = written(sized(docs, seed), "mix-sizes")
    plan = written(mixing_plan(sizes, weights, budget_share, max_epochs), "mix-plan")
    out = copies(sizes, plan, seed)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget_share: float = BUDGET_SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The documents as often as the mix takes them, with their own columns."""
    sizes = written(sized(docs, seed), "mix-sizes")
    plan = written(mixing_plan(sizes, weights, budget_share, max_epochs), "mix-plan")
    dropped(sizes)
    whole = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"))
    out = copies(whole, plan, seed, "_id", "_source").where("copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_n")).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table_of(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")

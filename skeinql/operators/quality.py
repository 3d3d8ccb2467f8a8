"""Data quality: rules, column profiles, constraint checks, masking and row policies."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the six dimensions in a column's score.
WEIGHTS = {"completeness": 0.25, "uniqueness": 0.15, "validity": 0.25, "consistency": 0.15, "accuracy": 0.15, "timeliness": 0.05}


def _share(test: Column, over: Column | None = None) -> Column:
    n = F.count(F.lit(1)) if over is None else F.count_if(over)
    return F.coalesce(F.count_if(test) / F.nullif(n, F.lit(0)), F.lit(1.0))


def completeness(c: str) -> Column:
    return _share(F.col(c).isNotNull())


def uniqueness(c: str) -> Column:
    """Distinct values over rows; null is a value."""
    return F.coalesce((F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(1.0))


def format_share(c: str, pattern: str) -> Column:
    return _share(F.col(c).rlike(pattern), F.col(c).isNotNull())


def range_share(c: str, low, high) -> Column:
    return _share(F.col(c).between(low, high), F.col(c).isNotNull())


def check_rules(df: DataFrame, rules: dict[str, Column], least: float = 0.95) -> DataFrame:
    """(rule, score, passed), all rules in one pass over the table."""
    one = df.agg(*[r.cast("double").alias(n) for n, r in rules.items()])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("score")) for n in rules])).alias("_r")).select("_r.*")
    return long.withColumn("passed", F.col("score") >= least)


def column_score(df: DataFrame, c: str, valid: Column, consistent: Column | None = None, accurate: Column | None = None, timely: Column | None = None) -> DataFrame:
    """The six dimensions of a column and their weighted score."""
    yes = F.lit(True)
    parts = {"completeness": completeness(c), "uniqueness": uniqueness(c), "validity": _share(valid, F.col(c).isNotNull()), "consistency": _share(yes if consistent is None else consistent), "accuracy": _share(yes if accurate is None else accurate), "timeliness": _share(yes if timely is None else timely)}
    one = df.agg(*[p.cast("double").alias(n) for n, p in parts.items()])
    return one.withColumn("score", sum((F.col(n) * w for n, w in WEIGHTS.items()), F.lit(0.0)))


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, rows, nulls, approx_distinct, min, max, shortest, longest, inferred), one pass over the table."""
    columns = list(columns or df.columns)
    each = []
    for c in columns:
        s = F.col(c).cast("string")
        kinds = [("integer", s.rlike(r"^[+-]?\d{1,18}$")), ("float", s.try_cast("double").isNotNull()), ("boolean", F.lower(s).isin("true", "false")), ("date", s.rlike(r"^\d{4}-\d\d-\d\d$")), ("timestamp", s.try_cast("timestamp").isNotNull())]
        inferred = F.lit("string")
        for name, test in reversed(kinds):
            inferred = F.when(F.coalesce(F.bool_and(test), F.lit(False)), name).otherwise(inferred)
        each.append(F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(s.isNull()).alias("nulls"), F.approx_count_distinct(c).alias("approx_distinct"), F.min(F.col(c)).cast("string").alias("min"), F.max(F.col(c)).cast("string").alias("max"), F.min(F.length(s)).alias("shortest"), F.max(F.length(s)).alias("longest"), inferred.alias("inferred")).alias(f"_{len(each)}"))
    one = df.agg(*each)
    return one.select(F.explode(F.array(*[F.col(f"_{i}") for i in range(len(each))])).alias("_p")).select("_p.*")


def top_values(df: DataFrame, c: str, k: int) -> DataFrame:
    return df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def patterns(df: DataFrame, c: str) -> DataFrame:
    """(pattern, n): letters as A or a, digits as 9."""
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), r"\p{Lu}", "A"), r"\p{Ll}", "a"), r"\d", "9")
    return df.groupBy(p.alias("pattern")).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, c: str, buckets: int, equal_depth: bool = False) -> DataFrame:
    """(bucket, low, high, n) of equal width, or of about equal depth by approximate quantiles."""
    if equal_depth:
        cuts = df.agg(F.percentile_approx(c, [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
        b = sum(((F.col(c) > x).cast("int") for x in cuts), F.lit(0))
    else:
        lo, hi = df.agg(F.min(c), F.max(c)).first()
        width = (hi - lo) / buckets if hi is not None and hi > lo else 1.0
        b = F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(width)), F.lit(buckets - 1)).cast("int")
    return df.where(F.col(c).isNotNull()).groupBy(b.alias("bucket")).agg(F.min(c).alias("low"), F.max(c).alias("high"), F.count("*").alias("n"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose foreign key has no parent (null keys are fine)."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def violations(df: DataFrame, check: Column) -> DataFrame:
    """Rows for which a check is false (null passes)."""
    return df.where(~F.coalesce(check, F.lit(True)))


# --- masking --------------------------------------------------------------------------------------

MASKS: dict[str, Callable[..., Column]] = {
    "full": lambda c, mark="*": F.regexp_replace(c, "(?s).", mark),
    "partial_last": lambda c, n=4, mark="*": F.concat(F.regexp_replace(F.left(c, F.greatest(F.length(c) - n, F.lit(0))), "(?s).", mark), F.right(c, F.lit(n))),
    "partial_first": lambda c, n=4, mark="*": F.concat(F.left(c, F.lit(n)), F.regexp_replace(F.substring(c, F.lit(n + 1), F.length(c)), "(?s).", mark)),
    "nullify": lambda c: F.lit(None).cast("string"),
    "hash": lambda c, salt="": F.sha2(F.concat(F.lit(salt), c), 256),
    "substitute": lambda c, values=("A", "B", "C"): F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64(c), F.lit(len(values))) + 1).cast("int")),
    "shuffle": lambda c, seed=1: F.array_join(F.transform(F.array_sort(F.transform(F.split(c, ""), lambda x, i: F.struct(F.xxhash64(x, i, F.lit(seed)).alias("h"), x.alias("x")))), lambda p: p["x"]), ""),
    "keep_format": lambda c: F.mask(c),
    "email": lambda c: F.regexp_replace(c, r"^(.).*(@.*)$", "$1***$2"),
    "card": lambda c: F.regexp_replace(c, r"\d(?=(?:\D*\d){4})", "*"),
    "ssn": lambda c: F.regexp_replace(c, r"^\d{3}-\d{2}", "***-**"),
    "phone": lambda c: F.regexp_replace(c, r"\d(?=(?:\D*\d){4})", "*"),
}


def masked(df: DataFrame, rules: dict[str, tuple]) -> DataFrame:
    """rules: column -> (kind, arguments...)."""
    return df.withColumns({c: MASKS[kind](F.col(c).cast("string"), *args) for c, (kind, *args) in rules.items()})


def secured(df: DataFrame, policies: dict[str, Column], roles: Sequence[str]) -> DataFrame:
    """Rows that a policy of one of the roles allows; none without a policy."""
    allowed = F.lit(False)
    for r in roles:
        if r in policies:
            allowed = allowed | policies[r]
    return df.where(allowed)

"""Full-text search over (id, text): an inverted index as a table, ranked and boolean search."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinql.functions.strings import stem

#: Words that are not indexed.
STOP_WORDS = "a an and are as at be by for from has he in is it its of on that the to was will with".split()


def tokens(text: Column, stop: Sequence[str] = STOP_WORDS, stemmed: bool = False) -> Column:
    """Lower-case runs of letters and digits, in order, without stop words."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: ~w.isin(list(stop)) if stop else F.lit(True))
    return F.transform(words, stem) if stemmed else words


def index(docs: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """(term, id, tf, positions)."""
    at = docs.select(F.col(id_col).alias("id"), F.posexplode(tokens(F.col(text_col), **how)).alias("pos", "term"))
    return at.groupBy("term", "id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def search(docs: DataFrame, id_col: str, text_col: str, query: Sequence[str], k: int | None = None) -> DataFrame:
    """(id, score): sum of tf * ln(N / df) over the terms. Only rows of the queried terms are counted."""
    wanted = [q.lower() for q in query]
    words = tokens(F.col(text_col))
    hits = docs.select(F.col(id_col).alias("id"), F.explode(F.filter(words, lambda w: w.isin(wanted))).alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    n = docs.agg(F.count("*").alias("n"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(n))  # a row for each queried term, and one
    out = scored.groupBy("id").agg(F.sum(F.col("tf") * F.log(F.col("n") / F.col("df"))).alias("score")).orderBy(F.desc("score"), "id")
    return out.limit(k) if k else out


def phrase(text: Column, words: Sequence[str]) -> Column:
    """Whether the words stand next to each other."""
    all_words = tokens(text, stop=())
    n = len(words)
    return F.exists(F.sequence(F.lit(1), F.greatest(F.size(all_words) - n + 1, F.lit(1))), lambda i: F.slice(all_words, i, n) == F.array(*[F.lit(w.lower()) for w in words]))


def wildcard(text: Column, pattern: str) -> Column:
    """Whether a word matches a pattern with * and ?."""
    regex = "^" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() else c) for c in pattern.lower()) + "$"
    return F.exists(tokens(text, stop=()), lambda w: w.rlike(regex))


def fuzzy(text: Column, word: str, distance: int) -> Column:
    return F.exists(tokens(text, stop=()), lambda w: F.levenshtein(w, F.lit(word.lower())) <= distance)


def boolean(text: Column, query: str) -> Column:
    """AND, OR, NOT and parentheses over words; words next to each other are joined by AND."""
    words = tokens(text, stop=())
    items = query.replace("(", " ( ").replace(")", " ) ").split()

    def either(at: int) -> tuple[Column, int]:
        out, at = every(at)
        while at < len(items) and items[at].upper() == "OR":
            right, at = every(at + 1)
            out = out | right
        return out, at

    def every(at: int) -> tuple[Column, int]:
        out, at = one(at)
        while at < len(items) and items[at].upper() != "OR" and items[at] != ")":
            right, at = one(at + 1 if items[at].upper() == "AND" else at)
            out = out & right
        return out, at

    def one(at: int) -> tuple[Column, int]:
        if at >= len(items):
            raise ValueError("the query ends too early")
        if items[at].upper() == "NOT":
            inner, at = one(at + 1)
            return ~inner, at
        if items[at] == "(":
            inner, at = either(at + 1)
            return inner, at + 1
        return F.array_contains(words, items[at].lower()), at + 1

    return either(0)[0]


def highlight(text: Column, words: Sequence[str], left: str = "<b>", right: str = "</b>") -> Column:
    return F.regexp_replace(text, F.lit(r"(?iu)\b(" + "|".join(re.escape(w) for w in words) + r")\b"), F.lit(f"{left}$1{right}"))

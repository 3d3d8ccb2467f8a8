"""A corpus from raw documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as Parquet and read again as
the next one's docs, and the table before it is removed. All but the last have the columns of documents,
whatever their names are.

Defined results: an empty table passes all stages and gives an empty result. A stage's docstring says what it
does with nulls, empty and very long texts, ties and repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeinql.llm.common import dropped, scratch_path, table_of, written
from skeinql.llm.op01_near_dedup import one_of_each
from skeinql.llm.op02_language_id import fit_dictionaries, identified
from skeinql.llm.op04_token_store import digests, write_tokens
from skeinql.llm.op06_mixing import mixed_documents
from skeinql.llm.op09_decontaminate import without_contaminated


#: Smaller than op4's own, as workers still hold memory of the stages before.
CACHE_CHUNKS = 75_000


#: Bytes of a batch that goes to Python, in all stages: workers and JVM keep the memory of the largest one.
BATCH_BYTES = 4 << 20


def _modest(spark: SparkSession) -> None:
    """From here on the session sends small batches to Python; a stage's result is computed after its function has ended."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells; those that it rejects go.

    Null texts, empty ones and those without a letter are rejected; a text of any length is judged whole;
    equal sizes (a tie) have no margin and are rejected; repeated rows stay or go together. Null lang,
    source and doc_id don't matter: dictionaries are learnt from the labelled rows there are.
    """
    _modest(spark)
    return identified(docs, fit_dictionaries(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id.

    Of rows with one doc_id one stays (with different texts: that with the smallest hash of the row); rows
    without a doc_id and texts without words are nobody's duplicates and stay; long texts are compared whole.
    """
    _modest(spark)
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts have no words and stay; repeated rows stay or go together; long texts are searched whole.
    """
    _modest(spark)
    return without_contaminated(docs, table_of(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source of its own; null and empty texts have size 0; rows with one doc_id, or without,
    are taken alike; a tie for the last place goes by the hash of doc_id, so reruns agree.
    """
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of doc_id; a row for each document in them, from the files.

    Null doc_ids come first; rows with one doc_id are all written; a null or empty text is the end id alone.
    """
    _modest(spark)
    return digests(write_tokens(docs, scratch_path(spark, "corpus-tokens"), cache_chunks=CACHE_CHUNKS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]

#: Compression, signatures and tokenizers are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table_of(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"corpus-{name}")
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

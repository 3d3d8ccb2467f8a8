"""Language identification by compression: one zstandard raw-content dictionary for each language.

A text is compressed whole with each dictionary, in pieces of ``PIECE`` bytes whose sizes are added up, so
that a long text's dictionary still counts in its last part; the language whose dictionary leaves the
fewest bytes wins. The margin is the saving of the best over the second best, relative to the second; a
text whose margin is below ``MIN_MARGIN`` is rejected (column ``rejected``), but still gets its prediction.

Dictionaries are fitted on a bounded sample: of each language ``SAMPLE_TEXTS`` different labelled texts,
those with the smallest hash, and of each a slice of at most ``SLICE`` characters that begins where its hash
says. A dictionary is as long as its slices make it, ``DICT_BYTES`` at most, whatever other languages have;
there may be any number of languages. Texts are lower-cased, and digits, marks and white space become one
space, so that dictionaries hold words rather than layout.

Defined results: a null text or one without letters (Unicode category L) is ``und`` with score 0 and
rejected; without labelled documents every text is ``und``; ties go to the first language in code point
order; repeated rows are judged alike; extra columns are left behind (or carried whole by ``identified``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinql.llm.common import arrow_column, bounded, dropped, fresh, quoted, released, table_of, written

DICT_BYTES = 96 << 10
SAMPLE_TEXTS = 400
SLICE = 1 << 10
PIECE = 16 << 10
LEVEL = 9
MIN_MARGIN = 0.01
UNKNOWN = "und"
VERDICT = "struct<lang_pred:string,score:double,margin:double,rejected:boolean>"

_LATIN = re.compile("[A-Za-z]")
_BREAKS = re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    return bool(_LATIN.search(text)) or any(map(str.isalpha, text))


def prepared(text: str) -> bytes:
    """Lower case words with a space before and after each."""
    return (" " + _BREAKS.sub(" ", text.lower()).strip() + " ").encode("utf-8", "surrogatepass")


def in_fold(doc_id: Column) -> Column:
    """The held-out fold: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_slices(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_TEXTS) -> DataFrame:
    """(l, h, t): for each language slices of the sampled texts.

    Copies are one text. A threshold on the hash, from a count of each language's texts, leaves about
    twice the sample before anything is ranked, so no language is gathered.
    """
    text = F.col(text_col).cast("string")
    known = labelled.select(F.col(lang_col).cast("string").alias("l"), F.xxhash64(text).alias("h"), text.alias("t")).where("l IS NOT NULL AND t IS NOT NULL AND t RLIKE '\\\\p{L}'")
    codes = written(known.select("l", "h").distinct(), "lang-codes")
    # the hash as a number from 0 to 1
    part = F.shiftrightunsigned("h", 11).cast("double") * F.lit(2.0**-53)
    few = codes.withColumn("u", part).join(bounded(written(codes.groupBy("l").agg(F.count("*").alias("n")), "lang-counts")), "l").where(F.col("u") * F.col("n") <= 2.0 * sample + 40)
    chosen = written(few.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("u", "h"))).where(F.col("k") <= sample).select("l", "h"), "lang-chosen")
    begin = F.pmod(F.xxhash64("h"), F.greatest(F.length("t") - SLICE + 1, F.lit(1)))
    out = known.join(bounded(chosen), ["l", "h"], "left_semi").select("l", "h", F.substring("t", begin.cast("int") + 1, F.lit(SLICE)).alias("t")).dropDuplicates(["l", "h"])
    out = written(out, "lang-slices")
    dropped(codes, chosen)
    return out


def fit_dictionaries(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_TEXTS) -> dict[str, bytes]:
    """Language -> dictionary content, from a bounded sample of labelled documents."""
    slices = training_slices(labelled, text_col, lang_col, sample)
    texts: dict[str, list[bytes]] = {}
    for r in slices.orderBy("l", F.col("h").desc()).toLocalIterator():  # at most SAMPLE_TEXTS slices of a language
        if has_letter(r.t):
            texts.setdefault(r.l, []).append(prepared(r.t))
    dropped(slices)
    # the end of a dictionary is the cheapest to refer to
    return {lang: b"".join(parts)[-DICT_BYTES:] for lang, parts in sorted(texts.items())}


def compressors(dictionaries: dict[str, bytes], level: int = LEVEL) -> list[tuple[str, Callable[[bytes], int]]]:
    import zstandard

    out = []
    for lang, content in sorted(dictionaries.items()):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level)
        c = zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
        out.append((lang, lambda data, c=c: len(c.compress(data))))
    return out


def classify(text: str | None, models: list[tuple[str, Callable[[bytes], int]]]) -> tuple[str, float, float]:
    """(language, score, margin). Score: certainty from 0 to 1, one half at the margin of rejection."""
    if not text or not models or not has_letter(text):
        return UNKNOWN, 0.0, 0.0
    data = prepared(text)
    pieces = [data[at : at + PIECE] for at in range(0, len(data), PIECE)]
    sizes = sorted((sum(map(size, pieces)), lang) for lang, size in models)
    if len(sizes) == 1:
        return sizes[0][1], 1.0, 1.0
    margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
    return sizes[0][1], margin / (margin + MIN_MARGIN), margin


def verdict(dictionaries: dict[str, bytes], text: Column, min_margin: float = MIN_MARGIN) -> Column:
    """(lang_pred, score, margin, rejected) of a column of texts. Only the texts go to Python."""

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        models = compressors(dictionaries)
        for batch in batches:
            found = [classify(t.as_py(), models) for t in batch]
            lang, score, margin = zip(*found) if found else ((), (), ())
            rejected = [x == UNKNOWN or m < min_margin for x, m in zip(lang, margin)]
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())], names=["lang_pred", "score", "margin", "rejected"])
        released()

    return arrow_column(judge, VERDICT)(text.cast("string"))


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """(id_col, lang_pred, score, margin, rejected) of every document."""
    return docs.select(F.col(id_col).alias("_id"), verdict(dictionaries, F.col(text_col), min_margin).alias("_v")).select(F.col("_id").alias(id_col), "_v.*")


def identified(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    v = fresh(docs, "verdict")
    return docs.withColumn(v, verdict(dictionaries, F.col(text_col), min_margin)).where(~F.col(v)["rejected"]).select([quoted(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_of(spark, sf_dir, "documents")
    dictionaries = fit_dictionaries(docs.where(~in_fold(F.col("doc_id"))))
    out = identify(docs, dictionaries)
    return out.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")

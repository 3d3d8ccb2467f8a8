import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, and a column whose name an operator might use."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 5, "x"),
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 5, "x"),
        (2, "", "en", "a", 0, None),
        (3, None, None, None, None, None),
        (None, "le renard brun saute par dessus le chien paresseux", "fr", "b", 9, "y"),
        (4, "word " * 60_000, "en", None, 1, "z"),
        (5, "?!... 123 ---", None, "b", 2, "z"),
        (6, "THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG AGAIN AND AGAIN", "en", "b", 5, "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string")
    return df.withColumns({"_text": F.lit("clash"), "_row": F.lit(1), "size": F.lit(2), "target": F.lit(3), "uid": F.lit(4)}).cache()


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(1, None, None, None, None), (None, "a null id", "en", "s", 9), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, " \t\n ", "en", None, 4), (4, "word " * 30_000, "en", "s", 150_000), (5, "x" * 120_000, "en", "s", 120_000), (6, "é ñ 日本 \x1c \xa0   end", "xx", "t'\\", 5)]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    names = ("score", "key", "base", "kept", "n_words", "bucket", "slot", "__id", "class_id", "x", "length", "w")
    return df.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")

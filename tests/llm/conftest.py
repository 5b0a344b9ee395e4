import pytest
from pyspark.sql import functions as F

LONG = "word " * 40_000


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, extra columns with names that operators use."""
    rows = [
        (1, None, "en", "a"),
        (2, "", None, "a"),
        (3, " \n\t ", "en", None),
        (4, LONG, "en", "b"),
        (5, "same text of some words", "en", "b"),
        (6, "same text  of some words", None, None),
        (6, "same text  of some words", None, None),
        (7, "same text of some words", "de", "b"),
        (None, "a row without an id, mail x@y.org", "en", "b"),
        (8, "x", "en", "b"),
        (9, "Ünïcode ‐ 日本語 😀 text", "ja", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("n_chars", "h", "norm", "rank", "kept", "rate", "n_copies", "copy_no", "shuffle_key", "node", "comp", "value", "fp", "key", "found", "kept_id", "bin", "n"):
        df = df.withColumn(name, F.lit(7).cast("long"))
    return df


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)

import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in each column, empty texts, repeated rows, ties, and columns with names that operators use."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 5, "x"),
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 5, "x"),
        (2, None, None, None, None, None),
        (3, "", "en", "b", 0, "y"),
        (None, "no id at all here", "de", "b", 4, "z"),
        (4, "Ünïcode ßtraße   𝄞 text\n\nline", "de", "c", 9, ""),
        (5, "word " * 30_000, "en", "c", 1, "long"),
        (6, "alpha beta gamma delta epsilon zeta", "fr", "a", 5, "copy"),
    ]
    kinds = [T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.LongType(), T.StringType()]
    names = ["doc_id", "text", "lang", "source", "n_chars", "score"]
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")

from pyspark.sql import types as T

import pytest

DOC = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    ]
)
#: Names that the operators use for their own columns or results.
CLASHES = ["rep", "bucket", "others", "_d", "_r", "drop", "kept", "n_words", "shard", "copy", "size", "target", "draws", "sources", "N_Lines", "key", "o", "b"]


def words(n, seed=0):
    """Plain words that differ by seed."""
    letters = str.maketrans("0123456789", "aeioubdkln")
    return [f"w{(i * 7919 + seed * 104729) % 99991}x".translate(letters) for i in range(n)]


def odd_rows():
    """Nulls in any column, blank and long texts, repeated rows and ids."""
    plain = " ".join(words(80, 3)) + "."
    long_ = "\n".join(" ".join(words(30, k)) + "." for k in range(10, 410))
    return [
        (1, plain, "en", "a", len(plain)), (1, plain, "en", "a", len(plain)), (2, plain, None, None, None), (3, None, "en", "a", None), (4, "", "en", "b", 0),
        (5, " \n\t ", None, "b", 4), (None, plain, "en", "a", 1), (None, None, None, None, None), (6, long_, "en", "c", len(long_)), (7, "short one", "en", "c", 9),
        (7, "another text of the same id", "en", "c", 9),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOC)


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)

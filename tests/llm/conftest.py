import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Names that the operators use for their own columns.
CLASHING = ["size", "taken", "score", "found", "fp", "key", "slice", "kept", "n_lines", "site", "part", "predicted", "range"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, lang, source) rows, cut short ones filled up; with clashing columns if asked."""

    def make(rows, clashing=False):
        from pyspark.sql import functions as F

        full = [(tuple(r) + ("en", "s")[len(r) - 2 :] if len(r) < 4 else tuple(r)) for r in rows]
        df = spark.createDataFrame([r + (len(r[1] or ""),) for r in full], DOCS)
        return df.select("*", *[F.lit("x").alias(c) for c in CLASHING]) if clashing else df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "b"), (4, long, "de", "a"), (5, "one", None, "a"),
        (6, "the same line\nthe same line", "en", "a"), (6, "the same line\nthe same line", "en", "a"), (None, "no id at all", "en", "b"),
        (7, "\U0001f600 \u0000 x", "fr", ""), (8, "…!?", "fr", "c"),
    ]

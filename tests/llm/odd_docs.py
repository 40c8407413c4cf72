"""Tables of odd rows that all operators must take."""

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("_id", T.StringType()), T.StructField("score", T.StringType())])  # two names the operators use themselves


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "x", "y") for i, t in rows], DOCS)
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, repeated rows, a repeated id, control strings, rare characters."""
    long = " ".join(f"w{i % 97}x{i % 89}" for i in range(4000))
    return [
        (1, "one two three four five six seven eight nine ten"), (2, None), (3, ""), (4, " \n\t "), (5, long), (5, long),
        (6, long + " end"), (None, "no id at all here"), (7, "<|endoftext|> mid <|startoftext|> Straße ΣΑΣ ÉÀ naïve 12345"),
        (8, "日本語のテキスト \u0870 ǅ \U0001f600 \U00010940"), (9, "a" * 3000), (7, "again seven")]

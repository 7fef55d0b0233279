import pytest
from pyspark.sql import types as T

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
BASE = " ".join(f"alpha{i} beta{i}" for i in range(40))

#: doc_id, text, source: nulls, empty, very long, ties, repeated rows
ROWS = [
    (1, BASE, "b"), (2, BASE, "a"), (3, BASE + " end", None), (4, "Few words Here", "a"), (5, "few WORDS here", "b"),
    (6, None, "a"), (7, "", None), (8, " \n\t ", "c"), (9, LONG, "c"), (10, "one", "c"), (11, "one", "c"), (11, "one", "c"),
    (12, "ünï çödé, täxt. " * 9, "b"), (None, "no id here at all", "a"), (13, "line one\nline two\n\n line one \nthree", "a"),
]
EXTRA = {"score": T.IntegerType(), "size": T.StringType(), "n": T.StringType(), "cls": T.StringType(), "rank": T.StringType(), "h": T.StringType(), "target": T.StringType(), "at": T.StringType(), "words": T.StringType(), "root": T.StringType()}


def schema():
    base = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
    return T.StructType(base + [T.StructField(k, t) for k, t in EXTRA.items()])


@pytest.fixture(scope="session")
def docs(spark):
    filler = [7, *["x"] * (len(EXTRA) - 1)]
    return spark.createDataFrame([(i, t, "en", s, *filler) for i, t, s in ROWS], schema()).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], schema())

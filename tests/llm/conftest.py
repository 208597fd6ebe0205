import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long = "word " * 60_000 + "end"
    rows = [(0, "Same text.", "en", "a", 1), (1, "same TEXT.", "en", "a", 1), (1, "same TEXT.", "en", "a", 1),
            (2, None, None, None, None), (3, "", "en", "b", 0), (4, long, "en", "a", 1), (None, "Same text.", "en", "a", 1),
            (None, None, None, None, None), (5, "É́ \x0b x", "fr", "b", 1), (6, "12 34 | 56", "fr", "b", 1), (6, "other text here", "en", "c", 2)]
    df = spark.createDataFrame(rows, DOCS)
    clash = ["id", "p", "s", "h", "b", "t", "fp", "r", "u", "norm", "kept", "keep_id", "copies", "copy", "rate", "carried",
             "share", "start", "row", "score", "lang_pred", "component_id", "fingerprint", "worker", "key", "x"]
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(clash)])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)

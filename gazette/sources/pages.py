"""Page and raw-text sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.functions.text import php_trim
from gazette.functions.urls import HAS_HTTP_RX, is_valid_url

PAGES_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])


def gate_pages(pages: DataFrame, url: str = "url") -> DataFrame:
    """S1 URL gate: trim, prefix https:// when there is no http(s) scheme, reject blank or
    invalid.  Adds ``reject_reason`` (null when accepted)."""
    t = php_trim(F.coalesce(F.col(url), F.lit("")))
    fixed = F.when(t.rlike(HAS_HTTP_RX), t).otherwise(
        F.concat(F.lit("https://"), F.regexp_replace(t, "^/+", "")))
    reason = (F.when(t == "", F.lit("URL is required"))
              .when(~is_valid_url(fixed), F.lit("Invalid URL format")))
    return pages.withColumn("reject_reason", reason).withColumn(
        url, F.when(t == "", t).otherwise(fixed))


def split_rejects(df: DataFrame, reason: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    ok = df.filter(F.col(reason).isNull()).drop(reason)
    bad = df.filter(F.col(reason).isNotNull())
    return ok, bad


def read_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted pages, rejects) from a parquet table of (page_id, url, html)."""
    return split_rejects(gate_pages(spark.read.schema(PAGES_SCHEMA).parquet(path)))


def gate_raw_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """Text mode — trimmed text required; no links and no source url."""
    t = php_trim(F.coalesce(F.col(text), F.lit("")))
    return (docs.withColumn(text, t)
                .withColumn("source_url", F.lit(""))
                .withColumn("reject_reason", F.when(t == "", F.lit("raw_text is required"))))


def read_raw_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents with text, rejects)."""
    return split_rejects(gate_raw_text(spark.read.parquet(path).select("doc_id", "text")))

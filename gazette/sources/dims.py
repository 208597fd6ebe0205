"""Dimensions (S5): live tables when they have rows, else the fixed fallback lists.

The fallback lists have tens of rows; a live table may have any number.  Lookups
join the dimension made unique by its key, and Spark picks the join by its size.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gazette.functions import rules


def fixed_list(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """The rows as literals of the plan: Spark knows their size and broadcasts them.  The size of a
    list that it is handed as an RDD is unknown, so that a join would shuffle the other side before it is found out."""
    fields = StructType.fromDDL(schema).fields
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)]) for row in rows])))


def dim_category(spark: SparkSession) -> DataFrame:
    """Name aliases -> category id (30 rows)."""
    return fixed_list(spark, rules.CATEGORY_IDS, "name string, category_id int")


def dim_category_fallback(spark: SparkSession) -> DataFrame:
    return fixed_list(spark, [(i + 1, id_, n) for i, (id_, n) in enumerate(rules.FALLBACK_CATEGORIES)],
                                 "ordinal int, id int, name string")


def dim_state(spark: SparkSession) -> DataFrame:
    return fixed_list(spark, [(i + 1, id_, n) for i, (id_, n) in enumerate(rules.FALLBACK_STATES)],
                                 "ordinal int, id int, name string")


def dim_org(spark: SparkSession) -> DataFrame:
    return fixed_list(spark, rules.ORG_ABBREVIATIONS, "abbrev string, full_name string")


def dim_aggregator(spark: SparkSession, site_host: str | None = None) -> DataFrame:
    rows = [(d,) for d in rules.AGGREGATOR_DOMAINS + ([site_host] if site_host else [])]
    return spark.createDataFrame(rows, "domain string")


def dim_card(spark: SparkSession) -> DataFrame:
    """Card layouts, one row a line."""
    return spark.createDataFrame([(t, k + 1, label, field, default) for t, layout in rules.CARD_LAYOUTS
                                  for k, (label, field, default) in enumerate(layout)],
                                 "type string, ordinal int, label string, source_field string, default string")


def vocab(spark: SparkSession, kind: str) -> DataFrame:
    values = rules.VOCAB_TAGS if kind == "tag" else rules.VOCAB_EDUCATION
    return spark.createDataFrame([(v,) for v in values], "code string")


def unique_dim(dim: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row per non-null ``key``: the first by ``order`` (else by all columns), so that a lookup
    join never multiplies rows.  There is no broadcast hint: Spark broadcasts the result where it
    measures it as small and shuffles it otherwise, with the same rows."""
    cols = ([order] if order else []) + [c for c in dim.columns if c not in (key, order)]
    first = dim.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*cols)).alias("_d"))
    return first.select(key, *[F.col("_d")[c].alias(c) for c in cols])


def load_dim(spark: SparkSession, path: str | None, fallback: DataFrame) -> DataFrame:
    """The live dimension at ``path`` if it exists and has rows, else the fallback list.  Any
    other error (rights, storage, a broken file) is raised: a fallback would change ids unseen."""
    if not path:
        return fallback
    try:
        live = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # no such table, or no file in it
            return fallback
        raise
    return fallback if live.isEmpty() else live

"""Exact dedup by content sort.

Sampled splitters cut the ordered normalised texts into ranges, each range is sorted externally, and
equal texts, then adjacent, form a group.  The order is (first 64 characters, SHA-256, whole text, id
hash): the short leading columns keep the sampled splitters small whatever the length of a text, and the
id hash lets a splitter fall inside a large group of copies, so that several ranges share it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.common import (array_literal, evenly, lower_ascii, lower_bound, shuffle_partitions)

PREFIX_CHARS = 64
SAMPLED_PER_RANGE = 24
RANGES_PER_PARTITION = 4
KEY = "struct<p:string,s:string,h:bigint>"


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                 carry: list[str] | None = None, seed: int = 4) -> DataFrame:
    """One row per row of ``docs``: <id_col>, keep_id, group_size, kept, text_sha256 (of the normalised
    text), and with ``carry`` a struct ``carried`` of those columns.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  ``keep`` is "smallest" or
    "largest": which id of a group stays.  Null ids rank below all others; a group with null ids only keeps
    one of them, with a null keep_id.  Of rows with the same text and id one is kept.  No rows give no rows;
    columns not named are ignored, whatever they are called.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    norm = lower_ascii(text)
    base = docs.select(docs[id_col].alias("id"), text.alias("text"),
                       F.struct(*[docs[c] for c in carry or []]).alias("carried") if carry else F.lit(None).alias("carried"),
                       F.substring(norm, 1, PREFIX_CHARS).alias("p"), F.sha2(norm, 256).alias("s"),
                       F.xxhash64(docs[id_col]).alias("h"))

    ranges = n * RANGES_PER_PARTITION
    want = ranges * SAMPLED_PER_RANGE
    total = docs.count()
    share = min(1.0, 1.2 * want / max(total, 1))
    sample = base.select("p", "s", "h").sample(False, share, seed) if share < 1 else base.select("p", "s", "h")
    keys = sorted(map(tuple, sample.collect()))
    cuts = evenly(keys, ranges)
    splitters = array_literal([dict(zip("psh", k, strict=True)) for k in cuts], KEY)
    key = F.struct("p", "s", "h")

    dealt = base.withColumn("b", lower_bound(splitters, len(cuts), key)).repartition(n, "b")
    dealt = dealt.withColumn("norm", lower_ascii(F.col("text")))
    best = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()
    run = Window.partitionBy("b", "p", "s", "norm").orderBy(best)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local = dealt.select(
        "id", "carried", "s",
        F.first("id").over(whole).alias("best"), F.count(F.lit(1)).over(whole).alias("size"),
        F.row_number().over(run).alias("rank"))

    # Groups that a splitter falls into lie in several ranges; there are no more of them than splitters.
    cut_shas = sorted({k[1] for k in cuts})
    across = (base.filter(F.col("s").isin(cut_shas)).groupBy("s", lower_ascii(F.col("text")).alias("norm"))
              .agg((F.min if keep == "smallest" else F.max)("id").alias("all_best"), F.count(F.lit(1)).alias("all_size"))
              .select(F.col("s").alias("s2"), "all_best", "all_size")) if cuts else None
    joined = (local.join(F.broadcast(across), F.col("s") == F.col("s2"), "left") if cuts else
              local.withColumn("all_best", F.col("best")).withColumn("all_size", F.col("size")))
    keep_id = F.when(F.col("all_size").isNotNull(), F.col("all_best")).otherwise(F.col("best"))
    out = joined.select(
        F.col("id").alias(id_col), keep_id.alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"),
        (F.col("id").eqNullSafe(keep_id) & (F.col("rank") == 1)).alias("kept"),
        F.col("s").alias("text_sha256"), "carried")
    return out if carry else out.drop("carried")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    rows = content_sort(docs, id_col, text_col, keep, carry=docs.columns)
    return rows.filter("kept").select("carried.*")

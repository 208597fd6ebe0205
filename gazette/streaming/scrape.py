"""Streaming forms.

T1: the page-facts plan over a file stream of pages.  Every scrape step is
row-wise and the links of a page travel inside its row, so each micro-batch is
processed by the same batch plan (``foreachBatch``) with exactly the batch
results; the sink is an idempotent per-batch overwrite keyed by batch id.

T2: drop a page whose lower-cased URL was already seen, ever (here) or within a horizon (``first_seen``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.config import DEFAULT_SITE, SiteConfig
from gazette.plans.scrape import FACT_COLUMNS, page_facts_all
from gazette.sources.pages import PAGES_SCHEMA


def read_page_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(PAGES_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def stream_scrape(spark: SparkSession, source: str, sink: str, checkpoint: str, name: str = "stream_scrape",
                  site: SiteConfig = DEFAULT_SITE, available_now: bool = True, max_files_per_trigger: int | None = None,
                  aggregators: Callable[[SparkSession], DataFrame] | None = None):
    """Start the stream; each batch is written once to ``sink/batch=<id>/status=facts|rejects``.
    ``aggregators`` loads the list of aggregators (S5) for each micro-batch: a batch works on the files that the table
    holds when it starts, and a change counts from the next batch on; without, the fixed list.
    ``sink`` and ``checkpoint`` are folders that all executors share; restarted on the same two, the
    stream goes on where it stopped.  Returns the StreamingQuery."""
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        status = F.when(F.col("reject_reason").isNull(), F.lit("facts")).otherwise(F.lit("rejects"))
        listed = aggregators and aggregators(batch.sparkSession)
        (page_facts_all(batch, site, listed).withColumn("status", status).write.mode("overwrite")
         .partitionBy("status").parquet(f"{sink}/batch={batch_id}"))

    w = (read_page_stream(spark, source, max_files_per_trigger).writeStream.foreachBatch(per_batch)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.queryName(name).start()


def read_facts(spark: SparkSession, sink: str) -> DataFrame:
    """What ``stream_scrape`` has accepted so far."""
    return spark.read.parquet(sink).filter("status = 'facts'").select(*FACT_COLUMNS)


def stream_first_seen(pages: DataFrame) -> DataFrame:
    """The first arrival of each lower-cased page URL.

    Exact whatever the age of a file: one key per URL is kept for good, so the session should use the RocksDB state
    store, which keeps it on disk.  ``first_seen.first_seen_within`` bounds the state by a horizon."""
    keyed = pages.withColumn("_url_key", F.lower(F.trim(F.col("url"))))
    return keyed.dropDuplicates(["_url_key"]).drop("_url_key")

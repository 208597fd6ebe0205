"""S6 on a stream: publish and quarantine as notices or answers arrive, each batch exactly once.

A micro-batch has two outputs, which no file sink commits together.  Both are staged under the batch's id, overwriting what an
interrupted attempt left there, and the batch counts only once its line is in the ledger.  Readers see the batches
of the ledger alone.  A batch that Spark repeats after a restart is skipped when the ledger has it, and written again
from the same input when it has not.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gazette.config import DEFAULT_SITE, SiteConfig
from gazette.plans.enrich import enrich_batch
from gazette.plans.publish import prepare_publish
from gazette.sources.sinks import write_postings
from gazette.streaming.answers import enrich_met
from gazette.streaming.first_seen import start_with_rocksdb

LEDGER = "batch long, published long, quarantined long, postings_schema string, quarantine_schema string"
# columns of a posting that an answer does not have
NOT_ANSWERED = {"category_id": "long", "state_id": "string", "final_result": "string", "exam_date": "string", "result_date": "string"}
Load = Callable[[SparkSession], DataFrame]


def ledger(spark: SparkSession, sink: str) -> DataFrame:
    """The committed batches; none before the first commit."""
    try:
        return spark.read.schema(LEDGER).json(f"{sink}/ledger/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def commit_batch(postings: DataFrame, rejects: DataFrame, sink: str, batch_id: int) -> None:
    """Stages both outputs, then writes the batch's line; the line's own write is one overwritten file."""
    spark = postings.sparkSession
    write_postings(postings, rejects, sink, batch=batch_id)
    tables = [(postings, "postings"), (rejects, "quarantine")]
    counts = [spark.read.schema(df.schema).parquet(f"{sink}/{name}/batch={batch_id}").count() for df, name in tables]
    line = (batch_id, *counts, *[df.schema.json() for df, _ in tables])
    spark.createDataFrame([line], LEDGER).coalesce(1).write.mode("overwrite").json(f"{sink}/ledger/batch={batch_id}")


def published(spark: SparkSession, sink: str) -> tuple[DataFrame, DataFrame]:
    """(postings, quarantine) of the committed batches, with their ``batch``, in the columns of the last one.  Folders of
    batches that are not in the ledger are never opened.  Nothing is published before the first commit (an error)."""
    done = ledger(spark, sink).orderBy("batch").collect()  # a line a batch
    if not done:
        raise ValueError(f"{sink}: no batch is committed yet")

    def table(name: str, rows: str) -> DataFrame:
        schema = StructType(StructType.fromJson(json.loads(done[-1][f"{name}_schema"])).fields).add("batch", "long")
        paths = [f"{sink}/{name}/batch={r['batch']}" for r in done if r[rows]]
        return spark.read.schema(schema).option("basePath", f"{sink}/{name}").parquet(*paths) if paths else spark.createDataFrame([], schema)

    return table("postings", "published"), table("quarantine", "quarantined")


def stream_publish(rows: DataFrame, sink: str, checkpoint: str, prepare: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
                   name: str = "stream_publish", available_now: bool = True, keyed_state: bool = False):
    """Starts the stream (``keyed_state``: with the state store that ``answers.meet_pages`` needs): each micro-batch of ``rows`` goes through ``prepare`` (V3, or V4 and V3) into two outputs
    under ``sink``.  ``sink`` and ``checkpoint`` are folders that all executors share.  Returns the StreamingQuery."""
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        if ledger(batch.sparkSession, sink).filter(F.col("batch") == batch_id).isEmpty():
            commit_batch(*prepare(batch), sink, batch_id)

    w = rows.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    w = w.queryName(name)
    return start_with_rocksdb(rows.sparkSession, w) if keyed_state else w.start()


def answers_to_postings(facts: Load, site: SiteConfig = DEFAULT_SITE, aggregators: Load | None = None,
                        categories: Load | None = None) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """``prepare`` for a stream of model answers: S3, V4, V3.  Page facts and dimensions are loaded for each micro-batch: a
    batch works on the files that a table holds when the batch starts, the next one on those that it holds then (a
    ``sources.dims.load_dim`` falls back to the fixed list once the table is emptied).

    Quarantined rows are (post_id, reject_reason): answers that cannot be parsed, and postings that miss a field."""
    def prepare(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        spark = batch.sparkSession
        return _publishable(*enrich_batch(batch, facts(spark), site, dim_aggregator=aggregators and aggregators(spark)), site, categories)

    return prepare


def met_to_postings(site: SiteConfig = DEFAULT_SITE, categories: Load | None = None) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """``prepare`` for a stream of answers that met their pages on the way (``answers.meet_pages``): S3, V4, V3.  Answers
    whose page never came are quarantined."""
    return lambda batch: _publishable(*enrich_met(batch, site), site, categories)


def _publishable(posts: DataFrame, unreadable: DataFrame, site: SiteConfig, categories: Load | None) -> tuple[DataFrame, DataFrame]:
    """V3 over what V4 gave, with V4's rejects among the quarantined."""
    posts = posts.withColumns({c: F.lit(None).cast(t) for c, t in NOT_ANSWERED.items() if c not in posts.columns}).drop("body", "parse_status")
    ready, missing = prepare_publish(posts, site, categories and categories(posts.sparkSession))
    return ready, missing.union(unreadable.select(F.col("response_id").alias("post_id"), "reject_reason"))

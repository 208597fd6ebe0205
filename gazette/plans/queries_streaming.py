"""Registered streaming queries (T1, T2): each runs its stream to completion
(``availableNow``) and returns what the sink holds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gazette.operators import links as L
from gazette.oracle import pages_sql as PS
from gazette.oracle import postings_sql as S
from gazette.plans.enrich import page_side
from gazette.plans.fixtures import load_postings_raw, load_responses, pages_ext
from gazette.plans.publish import prepare_publish
from gazette.plans.queries_postings import enriched_rows, v4_sql
from gazette.plans.registry import register
from gazette.plans.scrape import scrape_batch
from gazette.session import read_table, shared_path
from gazette.sources.dims import dim_category
from gazette.streaming.answers import enrich_met, meet_pages
from gazette.streaming.first_seen import start_with_rocksdb, write_first_seen
from gazette.streaming.publish import answers_to_postings, published, stream_publish
from gazette.streaming.scrape import read_facts, read_page_stream, stream_first_seen, stream_scrape


@register("t1_stream_scrape", PS.page_facts_sql("pages"))
def q_t1(spark, sf_dir):
    run = uuid.uuid4().hex
    sink = shared_path(spark, f"t1-{run}")
    q = stream_scrape(spark, f"{sf_dir}/pages.parq*", sink, f"{sink}-checkpoint", name=f"t1_{run[:12]}")
    q.awaitTermination()
    facts = read_facts(spark, sink)
    return facts.select("page_id", "url", "text", F.col("chars").cast("long").alias("chars"),
                        L.links_text(F.col("official_links")).alias("official_links"),
                        F.col("skipped_count").cast("long").alias("skipped_count"),
                        "featured_image", "page_title", "detected_type")


@register("t2_stream_first_seen", "SELECT page_id, url FROM pages")
def q_t2(spark, sf_dir):
    run = uuid.uuid4().hex
    src = shared_path(spark, f"t2-src-{run}")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    # the same pages arrive twice, as two files
    pages.write.parquet(f"{src}/a")
    pages.write.parquet(f"{src}/b")
    out = shared_path(spark, f"t2-out-{run}")
    q = (stream_first_seen(read_page_stream(spark, f"{src}/*")).select("page_id", "url")
         .writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-ckpt")
         .trigger(availableNow=True).queryName(f"t2_{run[:12]}").start())
    q.awaitTermination()
    return spark.read.parquet(out)


PASSES = """SELECT page_id, url, 0 AS pass, page_id % 24 AS at_hour FROM pages
UNION ALL SELECT page_id, url, 1, 48 + page_id % 24 FROM pages
UNION ALL SELECT page_id, url, 2, CASE page_id % 3 WHEN 0 THEN 60 + page_id % 24 WHEN 1 THEN 10 ELSE 100 + page_id % 24 END FROM pages"""

T2_HORIZON = f"""
WITH arrived AS ({PASSES}),
tops AS (SELECT pass, max(at_hour) AS top FROM arrived GROUP BY pass),
judged AS (SELECT a.*, coalesce(a.at_hour < (SELECT max(top) FROM tops t WHERE t.pass < a.pass) - 24, false) AS late FROM arrived a),
spans AS (SELECT *, at_hour - lag(at_hour) OVER (PARTITION BY lower(trim(url)) ORDER BY at_hour, pass) AS gap FROM judged WHERE NOT late)
SELECT page_id, url, at_hour, CAST(NULL AS VARCHAR) AS reject_reason FROM spans WHERE gap IS NULL OR gap >= 24
UNION ALL SELECT page_id, url, at_hour, 'older than the watermark' FROM judged WHERE late"""


@register("t2_first_seen_horizon", T2_HORIZON)
def q_t2_horizon(spark, sf_dir):
    """All pages are crawled three times and arrive one crawl after the other; the horizon is a day.  Each crawl is read by
    a stream started anew on the same folders: the second comes two days on (seen first again), of the third one part is
    half a day on (dropped), one is two days old (late) and one is two days on."""
    run = uuid.uuid4().hex
    src, sink = (shared_path(spark, f"t2h-{kind}-{run}") for kind in ("src", "out"))
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    hour = F.col("page_id") % 24
    third = F.when(F.col("page_id") % 3 == 0, hour + 60).when(F.col("page_id") % 3 == 1, F.lit(10)).otherwise(hour + 100)
    schema = "page_id long, url string, at_hour long, seen_at timestamp"
    for k, at in enumerate([hour, hour + 48, third]):
        timed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", at.cast("long").alias("at_hour"))
        timed.withColumn("seen_at", F.timestamp_seconds(F.col("at_hour") * 3600 + 1_700_000_000)).write.parquet(f"{src}/{k}")
        stream = spark.readStream.schema(schema).parquet(f"{src}/*")
        write_first_seen(stream, sink, f"{sink}-checkpoint", 24 * 3600, "seen_at", name=f"t2h_{k}_{run[:12]}").awaitTermination()
    seen = spark.read.schema(f"{schema}, reject_reason string").parquet(sink)
    return seen.select("page_id", "url", ((F.unix_seconds("seen_at") - 1_700_000_000) / 3600).cast("long").alias("at_hour"), "reject_reason")


def _streamed(spark, rows, name: str, batches: int, prepare):
    """``rows`` written as files by the tasks that make them, streamed through ``prepare`` in ``batches``, and what is then published.
    The stream deletes a batch's files once the batch is committed: they do not stay beside what is published from them."""
    src, sink = (shared_path(spark, f"{name}-{kind}-{uuid.uuid4().hex}") for kind in ("src", "out"))
    rows.write.option("compression", "zstd").parquet(src)
    files = len(spark.read.schema(rows.schema).parquet(src).inputFiles())
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).option("cleanSource", "delete").parquet(src)
    stream_publish(stream, sink, f"{sink}-checkpoint", prepare, name=f"{name}_{uuid.uuid4().hex[:12]}").awaitTermination()
    return published(spark, sink)


@register("s6_stream_postings", S.prepare_publish_sql())
def q_s6_stream(spark, sf_dir):
    """The postings arrive as files; V3 and both outputs a micro-batch."""
    from gazette.plans.queries_postings import published_rows
    prepare = lambda batch: prepare_publish(batch, dim_category=dim_category(spark))
    return published_rows(*_streamed(spark, load_postings_raw(spark, sf_dir), "s6", 3, prepare))


@register("v3_v4_stream_answers", None)
def q_v4_stream(spark, sf_dir):
    """The model answers arrive as files; S3, V4, V3 and S6 a micro-batch.  Postings and quarantine in one table."""
    facts = shared_path(spark, f"v4s-facts-{uuid.uuid4().hex}")
    page_side(scrape_batch(pages_ext(read_table(spark, sf_dir, "pages")))[0]).write.parquet(facts)  # scraped and scanned once, not by every batch
    prepare = answers_to_postings(lambda s: s.read.parquet(facts), categories=dim_category)
    ok, bad = _streamed(spark, load_responses(spark, sf_dir), "v4s", 3, prepare)
    ok = ok.select("post_id", F.lit(None).cast("string").alias("reject_reason"), "type", "title", "slug", "organization", "category_id",
                   F.array_join("tags", "|").alias("tags"), F.size("important_links").alias("n_links"), F.md5("content").alias("content_md5"))
    return ok.unionByName(bad.select("post_id", "reject_reason"), allowMissingColumns=True)


@register("v4_stream_answers_and_pages", v4_sql())
def q_v4_both_streams(spark, sf_dir):
    """Half of the answers arrive before their pages, half after; each part is read by a stream started anew on the same
    folders.  Pages that are rejected never come: their answers wait a day, until the pages are crawled again ten days
    on, and are kept as the batch plan keeps them."""
    asked_at, facts_at, sink = (shared_path(spark, f"v4j-{kind}-{uuid.uuid4().hex}") for kind in ("answers", "facts", "out"))
    at = lambda hours: F.timestamp_seconds(F.lit(hours * 3600 + 1_700_000_000))
    answers = load_responses(spark, sf_dir).withColumn("answered_at", at(0))
    facts = scrape_batch(pages_ext(read_table(spark, sf_dir, "pages")))[0].withColumn("scraped_at", at(1))
    late = F.col("response_id") % 2 == 1

    def run(name):
        asked, scraped = (spark.readStream.schema(df.schema).parquet(f"{folder}/*") for df, folder in ((answers, asked_at), (facts, facts_at)))
        met = meet_pages(asked, scraped, 24 * 3600, 5 * 24 * 3600, "answered_at", "scraped_at")
        w = met.writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{sink}-checkpoint")
        start_with_rocksdb(spark, w.trigger(availableNow=True).queryName(f"v4j_{name}_{sink[-12:]}")).awaitTermination()
        return met.schema

    answers.filter(~late).write.parquet(f"{asked_at}/0")
    facts.limit(0).write.parquet(f"{facts_at}/0")
    run("before")
    facts.write.parquet(f"{facts_at}/1")
    run("pages")
    answers.filter(late).withColumn("answered_at", at(2)).write.parquet(f"{asked_at}/2")
    spark.read.parquet(f"{facts_at}/1").withColumn("scraped_at", at(240)).write.parquet(f"{facts_at}/2")
    schema = run("after")
    return enriched_rows(enrich_met(spark.read.schema(schema).parquet(sink), keep_without_page=True)[0])

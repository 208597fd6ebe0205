"""Live dimension tables, and publishing on a stream."""
import uuid

import pytest
from helpers import SF_SMALL
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from gazette.functions import rules
from gazette.operators import links as L
from gazette.operators import normalize as N
from gazette.operators import reshape as R
from gazette.plans.enrich import enrich_batch
from gazette.plans.fixtures import load_postings_raw, load_responses, pages_ext
from gazette.plans.publish import prepare_publish
from gazette.plans.scrape import page_facts_all, scrape_batch
from gazette.session import read_table, shared_path
from gazette.sources import dims
from gazette.streaming import publish
from gazette.streaming.scrape import read_facts, stream_scrape


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def pages(spark):
    return pages_ext(read_table(spark, SF_SMALL, "pages"))


@pytest.fixture(params=[5_000, 0], ids=["set", "join"])
def looked_up(request, monkeypatch):
    monkeypatch.setattr(L, "LITERAL_DOMAINS", request.param)


def test_fixed_list_as_a_table(spark, pages, looked_up):
    live = dims.dim_aggregator(spark).union(spark.createDataFrame([(None,), ("",), (" GOV.IN.example ",)], "domain string"))
    assert rows(page_facts_all(pages, dim_aggregator=live)) == rows(page_facts_all(pages))
    repeated = pages.withColumn("page_id", F.when(F.col("page_id") % 3 == 0, F.lit(None)).otherwise(F.col("page_id") % 5))
    assert rows(page_facts_all(repeated, dim_aggregator=live)) == rows(page_facts_all(repeated))


def test_listed_hosts(spark):
    df = spark.createDataFrame([(1, ["a.b.example", "x.example"]), (2, []), (None, ["b.example", "ab.example"]), (1, ["b.example"])],
                               "page_id int, hosts array<string>")
    live = spark.createDataFrame([("B.example",), ("b.example",), (None,)], "domain string")
    got = L.with_listed_hosts(df, F.col("hosts"), live, "page_id", "listed")
    found = {(r["page_id"], tuple(r["hosts"])): {h for h in r["hosts"] if h in r["listed"]} for r in got.collect()}
    assert found == {(1, ("a.b.example", "x.example")): {"a.b.example"}, (2, ()): set(), (None, ("b.example", "ab.example")): {"b.example"},
                     (1, ("b.example",)): {"b.example"}}


def test_answers_with_a_table_of_aggregators(spark, pages, looked_up):
    facts, answers = scrape_batch(pages)[0], load_responses(spark, SF_SMALL).filter("response_id < 300")
    live = dims.dim_aggregator(spark)
    assert rows(enrich_batch(answers, facts, dim_aggregator=live)[0]) == rows(enrich_batch(answers, facts)[0])


def test_organizations_and_cards_from_tables(spark):
    p = load_postings_raw(spark, SF_SMALL)
    assert rows(N.resolve_organization(p, dims.dim_org(spark))) == rows(N.resolve_organization(p))
    assert rows(R.card_rows(p, dims.dim_card(spark))) == rows(R.card_rows(p))
    twice = dims.dim_org(spark).union(dims.dim_org(spark))
    assert N.resolve_organization(p, twice).count() == p.count()


def answers_stream(spark, folder):
    return spark.readStream.schema("post_id long, page_id long, response_id long, body string").option("maxFilesPerTrigger", 1).parquet(folder)


def test_publish_equals_batch_after_a_kill_between_the_writes(spark, pages, monkeypatch):
    run = uuid.uuid4().hex
    src, sink, facts_at = (shared_path(spark, f"{k}-{run}") for k in ("answers", "published", "facts"))
    scrape_batch(pages)[0].write.parquet(facts_at)
    answers = load_responses(spark, SF_SMALL).filter("response_id < 600").repartition(3)
    answers.write.parquet(src)
    answers = spark.read.parquet(src)
    prepare = publish.answers_to_postings(lambda s: s.read.parquet(facts_at), categories=dims.dim_category)
    start = lambda: publish.stream_publish(spark.readStream.schema(answers.schema).option("maxFilesPerTrigger", 1).parquet(src),
                                           sink, sink + "-checkpoint", prepare, name="p" + uuid.uuid4().hex[:8])
    whole = publish.write_postings

    def killed(postings, rejects, path, batch):
        if batch == 1:
            postings.write.partitionBy("type").parquet(f"{path}/postings/batch={batch}")
            raise RuntimeError("killed between the two writes")
        whole(postings, rejects, path, batch=batch)

    monkeypatch.setattr(publish, "write_postings", killed)
    with pytest.raises(StreamingQueryException):
        start().awaitTermination()
    assert [r["batch"] for r in publish.ledger(spark, sink).collect()] == [0]
    first = rows(publish.published(spark, sink)[0])
    monkeypatch.setattr(publish, "write_postings", whole)
    start().awaitTermination()
    assert sorted(r["batch"] for r in publish.ledger(spark, sink).collect()) == [0, 1, 2]
    ok, bad = publish.published(spark, sink)
    want_ok, want_bad = prepare(answers)
    assert rows(ok.select(want_ok.columns)) == rows(want_ok) and set(first) <= set(rows(ok))
    assert rows(bad.select(want_bad.columns)) == rows(want_bad) and bad.count() > 0

    # the same batch once more changes nothing, even with other rows
    before = rows(ok), rows(bad)
    spark_batch = answers.limit(5)
    if publish.ledger(spark, sink).filter("batch = 2").isEmpty():
        publish.commit_batch(*prepare(spark_batch), sink, 2)
    ok, bad = publish.published(spark, sink)
    assert (rows(ok), rows(bad)) == before


def test_nothing_published_yet(spark):
    sink = shared_path(spark, f"none-{uuid.uuid4().hex}")
    assert publish.ledger(spark, sink).count() == 0
    with pytest.raises(ValueError):
        publish.published(spark, sink)
    ok, bad = prepare_publish(load_postings_raw(spark, SF_SMALL))
    publish.commit_batch(ok.limit(0), bad.limit(0), sink, 0)  # an empty batch
    ok, bad = publish.published(spark, sink)
    assert ok.count() == bad.count() == 0 and "slug" in ok.columns and "reject_reason" in bad.columns


def test_a_batch_reads_the_list_of_its_time(spark):
    """The list changes between two batches; the third finds it empty and falls back."""
    run = uuid.uuid4().hex
    src, sink, live = (shared_path(spark, f"{k}-{run}") for k in ("pages", "facts", "aggregators"))
    fallback = dims.dim_aggregator(spark)
    listed = rules.AGGREGATOR_DOMAINS[0]
    html = f"<a href='https://{listed}/x.pdf'>One notice here</a><a href='https://other.example/y.pdf'>Two notice here</a>" + "text " * 60

    def arrive(k):
        spark.createDataFrame([(k, f"https://page{k}.test.org/p", html)], "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(src)
        stream_scrape(spark, src, sink, sink + "-checkpoint", name=f"b{k}{run[:8]}",
                      aggregators=lambda s: dims.load_dim(s, live, fallback)).awaitTermination()

    arrive(1)  # no table: the fixed list
    spark.createDataFrame([("other.example",)], "domain string").write.parquet(live)
    arrive(2)  # the table holds another host
    spark.createDataFrame([], "domain string").write.mode("overwrite").parquet(live)
    arrive(3)  # emptied: the fixed list again
    got = {r["page_id"]: [x["url"] for x in r["official_links"]] for r in read_facts(spark, sink).collect()}
    assert got == {1: ["https://other.example/y.pdf"], 2: [f"https://{listed}/x.pdf"], 3: ["https://other.example/y.pdf"]}

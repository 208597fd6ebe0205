"""Whole texts, entities, tags, dates, linear lists, dimensions, answers, restarts."""
import datetime
import html
import json
import time

import pytest
from helpers import one_col
from pyspark.sql import functions as F

from gazette.functions.text import decode_entities, strip_tags
from gazette.operators import enrich as E
from gazette.operators import links as L
from gazette.operators import normalize as N
from gazette.operators import pages as P
from gazette.operators import posting_links as PL
from gazette.sources import responses as RS
from gazette.operators.name_match import match_dim_table
from gazette.sources.dims import dim_category, load_dim, unique_dim


def test_entities_against_the_standard_library(spark):
    vals = ["India&rsquo;s fee &#8377;100 &hellip; &#x2013;", "&amp;lt;", "&notin; &bogus; & &;", "&nbsp;&AMP;&lt", "a&b;c", "&NotEqualTilde;", "plain", "", None,
            "&#65;&#x42;&#X43;", "x" * 10_000 + "&eacute;"]
    got = one_col(spark, vals, decode_entities)
    assert got[8] is None
    for v, g in zip(vals, got):
        if v is not None and "&lt" != v[-3:] and "&notin" not in v:
            assert g == html.unescape(v), v
    assert got[2] == "∉ &bogus; & &;" and got[3] == "\xa0&&lt"
    kept = ["&#0;", "&#xD800;", "&#x110000;", "&#xFFFE;", "&#128;", "&#11;", "&#99999999;"]
    assert one_col(spark, kept, decode_entities) == kept


def test_tags(spark):
    vals = ["<p>age < 30 and marks > 50</p>", '<a title="x > y" href="/a">Go</a>', "<b\nclass='>'>t</b>", "a <b", "1<2>3", "<" + "a" * 50_000, "<!-- c -->x"]
    assert one_col(spark, vals, strip_tags) == ["age < 30 and marks > 50", "Go", "t", "a <b", "13", vals[5], "x"]


def test_a_long_page_keeps_its_last_word(spark):
    page = "<html><body><p>" + "word " * 3000 + "lastword</p><p>answer key</p></body></html>"
    df = spark.createDataFrame([(1, "https://a.in/x", page)], "page_id long, url string, html string")
    row = P.with_detected_type(P.with_page_title(P.extract_text(df))).first()
    assert "lastword" in row["text"] and row["detected_type"] == "answer_key"
    row = P.with_detected_type(P.with_page_title(P.extract_text(df, max_chars=100)), window_bytes=5000).first()
    assert row["text"].endswith(" [truncated]") and row["detected_type"] == "job"


def test_dates(spark):
    good = ["15 June 2026", "June 15, 2026", "15-Jun-2026", "2026-6-15", "20260615", "6/15/2026", "15.6.2026", "15-06-2026", "Monday, 15 Jun 2026", "15th june 2026",
            "June 15th 2026", "2026-06-15T10:30:00", "2026-06-15 10:30", "15 Jun 2026 at 5 pm", " 2026/06/15 ", "15 Sept 2026", "2026-02-31"]
    want = [datetime.date(2026, 6, 15)] * 15 + [datetime.date(2026, 9, 15), datetime.date(2026, 3, 3)]
    assert one_col(spark, good, N.parse_date) == want
    bad = ["As per notice", "", None, "June 2026", "15-13-2026", "32 June 2026", "June", "2026", "1.2"]
    assert one_col(spark, bad, N.parse_date) == [None] * len(bad)
    assert one_col(spark, ["1999-12-31", "June 5, 2026"], N.safe_date) == ["Check Notification", "05-06-2026"]


def test_link_lists_are_linear(spark):
    def seconds(n):
        arr = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(
            i.alias("pos"), F.concat(F.lit("https://A.in/"), (i % (n // 2)).cast("string")).alias("url"), F.lit("t").alias("title")))
        df = spark.range(1).withColumn("links", arr)
        df = L.dedupe_links(df).withColumn("m", PL.merge_links(L.to_title_url(F.col("links")), L.to_title_url(F.col("links")))).withColumn("r", PL.replace_pdf_link("m", F.lit("h")))
        t = time.perf_counter()
        row = df.select(F.size("links").alias("a"), F.size("m").alias("b"), F.size("r").alias("c")).first()
        assert tuple(row) == (n // 2, n // 2, n // 2 + 1)
        return time.perf_counter() - t
    seconds(1000)
    small, large = seconds(4000), seconds(16000)
    assert large < 8 * max(small, 0.5)


def test_dimensions(spark, tmp_path):
    two = spark.createDataFrame([("Banking", 7), ("Banking", 3), ("X", 1), (None, 9)], "name string, category_id int")
    df = spark.createDataFrame([(1, "Banking", ""), (2, "none", "")], "post_id long, category_name string, category_id string")
    assert sorted(tuple(r) for r in E.resolve_category_id(df, two).select("post_id", "category_id").collect()) == [(1, 3), (2, 14)]
    assert unique_dim(two, "name").count() == 2
    fallback = dim_category(spark)
    assert load_dim(spark, f"{tmp_path}/none", fallback) is fallback
    two.limit(0).write.parquet(f"{tmp_path}/empty")
    assert load_dim(spark, f"{tmp_path}/empty", fallback) is fallback
    two.write.parquet(f"{tmp_path}/live")
    assert load_dim(spark, f"{tmp_path}/live", fallback).count() == 4
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        load_dim(spark, f"{tmp_path}/broken", fallback).count()


def test_match_dim_table_equals_the_literal_list(spark):
    entries = [(10, "Uttar Pradesh"), (11, "Andhra Pradesh"), (12, "Goa"), (13, "All India"), (14, "Goa Daman"), (15, "goa")]
    dim = spark.createDataFrame([(i + 1, k, n) for i, (k, n) in enumerate(entries)], "ordinal int, id int, name string")
    names = ["Goa", " goa ", "pradesh", "Madhya Pradesh", "", None, "India", "Goa Daman and Diu", "zzz", "a", "Pradesh Pradesh"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "k int, n string")
    cols = ["k", "s_id", "s_match", "s_score"]
    a = sorted(map(tuple, E.match_dim_by_name(df, "n", entries, "s").select(cols).collect()))
    b = sorted(map(tuple, match_dim_table(df, "n", dim, "s").select(cols).collect()))
    assert a == b
    many = spark.range(50_000).select((F.col("id") + 100).cast("int").alias("ordinal"), F.col("id").cast("int").alias("id"),
                                      F.concat(F.lit("q"), F.hex(F.xxhash64("id"))).alias("name"))
    c = sorted(map(tuple, match_dim_table(df.filter("n in ('Goa', 'Madhya Pradesh')"), "n", dim.union(many), "s").select(cols).collect()))
    assert c == [r for r in a if r[0] in (0, 3)]


def test_answers(spark):
    bodies = ['{"title":"a"}', '{"title":"a"} extra', '{"title":"a"}}', '{"title":"a"}]', '{"title":"a"},{"title":"b"}', '{"title":"a","title":"b"}',
              '```json\n{"title":"a"}\n```', '{"title":"a', '["x"]', "", None, '{"title":"a"}, "k": 1', '{"tags":["x"]']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    got = {r["i"]: (r["parse_status"], r["title"]) for r in RS.read_responses(df).collect()}
    assert [got[i][0] for i in range(len(bodies))] == ["parsed", "rejected", "rejected", "rejected", "rejected", "parsed", "parsed", "repaired",
                                                      "rejected", "rejected", "rejected", "rejected", "repaired"]
    assert got[5][1] == "b" and got[7][1] == "a"


def test_building_queries_starts_no_job_and_writes_nothing(spark):
    from gazette.plans.scrape import scrape_batch
    from gazette.plans.publish import prepare_publish
    spark.sparkContext.setJobGroup("built", "built")
    pages = spark.createDataFrame([(1, "https://a.in/x", "<p>" + "long enough " * 20 + "</p>")], "page_id long, url string, html string")
    ok, _ = scrape_batch(pages)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("built") == []
    spark.sparkContext.setJobGroup("rest", "rest")
    plan = ok.select("page_id", "official_links")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("noscript") <= 2  # the text chain is there once, for the length gate
    assert prepare_publish


def test_a_restarted_stream_reads_each_page_once(spark, tmp_path):
    from gazette.streaming.scrape import read_facts, stream_scrape
    for k in range(4):
        rows = [(10 * k + j, f"https://a.in/{k}/{j}", "<p>" + "some words here " * 20 + "</p>") for j in range(3)]
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/src")
    where = (f"{tmp_path}/src", f"{tmp_path}/sink", f"{tmp_path}/ckpt")
    q = stream_scrape(spark, *where, name="first", max_files_per_trigger=1, available_now=False)
    end = time.time() + 60
    while not q.recentProgress and time.time() < end:
        time.sleep(0.2)
    q.stop()
    stream_scrape(spark, *where, name="second").awaitTermination()
    ids = sorted(r["page_id"] for r in read_facts(spark, where[1]).collect())
    assert ids == sorted(10 * k + j for k in range(4) for j in range(3))


def test_hits_are_exact(spark):
    words = ["b.tech", "tech", "b.te", "graduat", "graduate degree", "10+2", "10", "a b", "é", "|x", "under_score", "te"]
    texts = ["b.tech and tech", "graduates", "graduate degree", "10+2", "a  b a b", "café |x under_score", "", "biotech b.te", None]
    got = one_col(spark, texts, lambda c: F.array_sort(E.literal_hits(c, words)))
    assert got == [None if t is None else sorted(w for w in words if w in t) for t in texts]
    assert json.loads(json.dumps(got))

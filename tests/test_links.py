"""Example tables for the link rules (values worked out by hand from the source rules)."""
from pyspark.sql import functions as F

from gazette.functions.urls import bare_host, is_valid_url, registrable_domain
from gazette.operators import links as L
from gazette.operators import posting_links as PL

from helpers import one_col


def test_registrable_domain(spark):
    cases = {
        "https://www.ssc.nic.in/a": "ssc.nic.in", "https://a.b.example.com/x": "example.com",
        "http://upsc.gov.in": "upsc.gov.in", "https://foo.co.in/": "foo.co.in", "https://localhost/": "localhost",
        "https://WWW.Example.ORG/": "example.org", "https://x.y.org.in/q": "y.org.in",
    }
    assert one_col(spark, list(cases), registrable_domain) == list(cases.values())


def test_url_validity(spark):
    cases = {"https://a.b/c?d=1#e": True, "https://bad_host.in/x": False, "https://-bad.nic.in/": False,
             "https://ok.nic.in/café": False, "https://a b.com/": False, "http://x.com:8080/p": True,
             "ftp://x.com/": False, "https://x.com:abc/": False, "https://user:pw@x.com/": True}
    assert one_col(spark, list(cases), is_valid_url) == list(cases.values())


def test_link_class(spark):
    src = "example.com"
    cases = {
        "https://sub.example.com/x": "aggregator",           # the page's own site
        "https://www.freejobalert.com/a": "aggregator",      # listed
        "https://m.naukri.com/jobs": "aggregator",           # under a listed domain
        "https://ssc.nic.in/apply": "official",              # anchored pattern
        "https://ibps.in/": "official",                      # substring pattern
        "https://files.random.in/notice.PDF": "official",    # pdf path
        "https://random.org/page": "unknown",
        "https://bad_host.gov.in/x": "unknown",              # invalid
        "https://notnaukri.com/": "unknown",                 # suffix without a dot is not "under"
    }
    got = one_col(spark, list(cases), lambda u: L.link_class_of(u, bare_host(u), F.lit(src)))
    assert got == list(cases.values())


def test_title_profiles(spark):
    rows = [("Click here", "https://ssc.nic.in/apply?x=1", 1), ("12345", "https://drdo.gov.in/login", 2),
            ("ab", "https://bsf.gov.in/page", 3), ("Real Title", "https://x.org/apply", 4),
            ("", "https://x.org/nothing", 5), ("official", "https://x.org/re-register", 6)]
    df = spark.createDataFrame(rows, "t string, u string, n int")
    t, lu = F.trim("t"), F.lower("u")
    got = df.select(L.title_server(t, lu, F.col("n")).alias("s"), L.title_client(t, lu, F.col("n")).alias("c"),
                    L.title_table(t, lu, F.col("n"), F.col("t")).alias("tb")).collect()
    assert [r.s for r in got] == ["Apply Online", "Candidate Login Portal", "Official Website", "Real Title",
                                  "Official Link 5", "Re-Apply / Re-Register"]
    assert [r.c for r in got] == ["Apply Online", "Official Website", "ab", "Real Title", "Important Link 5",
                                  "official"]
    assert [r.tb for r in got] == ["Click here", "Official Link 2", "ab", "Real Title", "Official Link 5", "official"]


def test_link_kind(spark):
    cases = {"Apply Online": "apply", "Download Admit Card": "admit", "Final Result / Merit List": "final_result",
             "Check Result": "score", "Official Website": "official", "Telegram Channel": "channel",
             "Fee / Payment Link": "payment", "Something": "link", "Official Notification PDF": "official"}
    assert one_col(spark, list(cases), lambda t: L.link_kind(F.lower(t))) == list(cases.values())


def _links_df(spark):
    html = ('<a href="/a">A</a><a href="/A">dup by case</a><a href="mailto:x@y">m</a>'
            '<a href="//cdn.isro.gov.in/s">x</a><a href="rel/p">rel</a><a href="#top">t</a>'
            '<a href="https://ibps.in/?a=1&amp;b=2">I &amp; <b>J</b></a>')
    return spark.createDataFrame([(1, "https://www.site.example.com:8080/dir/page?q=1", html)],
                                 "page_id long, url string, html string")


def test_page_link_pipeline(spark):
    df = L.page_links(_links_df(spark))
    out = L.explode_links(df, "links", ["page_id"], ["url", "title", "link_class"]).orderBy("n").collect()
    assert [r.url for r in out] == ["https://www.site.example.com/a", "https://cdn.isro.gov.in/s",
                                    "https://www.site.example.com/dir/rel/p", "https://ibps.in/?a=1&b=2"]
    assert [r.link_class for r in out] == ["aggregator", "official", "aggregator", "official"]
    assert out[3].title == "I &amp; J"


def test_dedupe_is_idempotent(spark):
    df = L.page_links(_links_df(spark))
    once = df.select(L.links_text(F.col("links"))).first()[0]
    twice = L.dedupe_links(df).select(L.links_text(F.col("links"))).first()[0]
    assert once == twice


def test_merge_keeps_every_official_link(spark):
    off = [("Official A", "https://a.gov.in/x"), ("Official A again", "https://A.gov.in/x")]
    cand = [("dup", "https://a.gov.in/X"), ("new", "https://b.nic.in/y"), ("new dup", "https://B.nic.in/y")]
    df = spark.createDataFrame([(off, cand)], "off array<struct<title:string,url:string>>, "
                                              "cand array<struct<title:string,url:string>>")
    merged = df.select(PL.merge_links("off", "cand").alias("m")).first().m
    assert [m.url for m in merged] == ["https://a.gov.in/x", "https://A.gov.in/x", "https://b.nic.in/y"]
    assert merged[2].title == "new"


def test_links_are_worked_out_once_for_all_channels(spark):
    """L15-L17 as one expression; each step's input and each URL's host stand in the plan once."""
    from gazette.config import DEFAULT_SITE
    from gazette.functions.urls import HOST_RX
    link = "array<struct<title:string,url:string>>"
    rows = [([("A", "https://a.gov.in/x")], [("b", " b.nic.in/y "), ("own", "https://www.src.com/z"), (None, "https://t.me/examplejobs"), ("bad", "http://x y")], "https://www.src.com/p"),
            (None, None, None), ([], [("c", "https://c.in/whatsapp.com/channel/1")], "")]
    df = spark.createDataFrame(rows, f"off {link}, cand {link}, src string")
    made = df.select(PL.ensure_channel_links(PL.merge_links("off", PL.sanitize_candidate_links("cand", "src"))).alias("m"))
    site = [url for _, _, url in DEFAULT_SITE.channels]
    assert [[x.url for x in r.m] for r in made.collect()] == [
        ["https://a.gov.in/x", "https://b.nic.in/y", "https://t.me/examplejobs", site[1]], site, ["https://c.in/whatsapp.com/channel/1", site[0]]]
    links = F.array(F.struct(F.lit("t").alias("title"), F.md5("src").alias("url")))
    plan = df.select(PL.ensure_channel_links(links).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("md5(") == 1
    asked = []
    df.select(PL.sanitize_candidate_links("cand", "src", listed=lambda host: asked.append(host) or F.lit(False)))
    assert HOST_RX not in str(asked)  # the bound host, not the regex again

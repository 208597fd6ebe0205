"""Registered queries over ``pages`` (S1, L1..L13, P1..P6, V8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette.config import DEFAULT_SITE
from gazette.functions.urls import bare_host
from gazette.oracle import pages_sql as PS
from gazette.oracle import sqlfn as q
from gazette.operators import links as L
from gazette.plans.registry import register
from gazette.plans.scrape import scrape_batch
from gazette.session import read_table


def _pages(spark, sf_dir):
    return read_table(spark, sf_dir, "pages")


@register("p6_scrape_batch", PS.page_facts_sql("pages"))
def q_scrape_batch(spark, sf_dir):
    facts, _ = scrape_batch(_pages(spark, sf_dir))
    return (facts.select("page_id", "url", "text", F.col("chars").cast("long").alias("chars"),
                         L.links_text(F.col("official_links")).alias("official_links"),
                         F.col("skipped_count").cast("long").alias("skipped_count"),
                         "featured_image", "page_title", "detected_type"))


# ---------------------------------------------------------------- on derived pages_ext (B1)
from gazette.operators import pages as P  # noqa: E402
from gazette.oracle.fixtures_sql import pages_ext_cte, pages_url_variants_cte  # noqa: E402
from gazette.plans.fixtures import pages_ext, pages_url_variants  # noqa: E402
from gazette.sources.pages import gate_pages, split_rejects  # noqa: E402


def _ext_ok(spark, sf_dir):
    ok, _ = split_rejects(gate_pages(pages_ext(_pages(spark, sf_dir))))
    return L.with_page_context(ok)


def _ext_links(spark, sf_dir, upto: str):
    df = L.extract_links(_ext_ok(spark, sf_dir))
    if upto == "l1":
        return df
    df = L.clean_anchor_text(df)
    df = L.drop_non_web(df)
    df = L.resolve_links(df)
    df = L.filter_valid_urls(df)
    if upto == "l5":
        return df
    df = L.dedupe_links(df)
    if upto == "l6":
        return df
    return L.classify_links(df)


def _long(df, fields):
    return df.select("page_id", F.explode("links").alias("l")).select(
        "page_id", *[F.col("l")[f].alias(a) for f, a in fields])


@register("s1_read_pages", f"""WITH {pages_url_variants_cte()}
gated AS ({PS.gated_pages_sql('pages_urls')})
SELECT page_id, url, reject_reason FROM gated""")
def q_read_pages(spark, sf_dir):
    return gate_pages(pages_url_variants(_pages(spark, sf_dir))).select("page_id", "url", "reject_reason")


@register("l1_extract_links", PS.ext_links_sql(
    "page_id, CAST(pos AS BIGINT) AS pos, raw_href, raw_title", "raw_links"))
def q_extract_links(spark, sf_dir):
    return _long(_ext_links(spark, sf_dir, "l1"), [("pos", "pos"), ("raw_href", "raw_href"),
                                                   ("raw_title", "raw_title")]).withColumn(
        "pos", F.col("pos").cast("long"))


@register("l2_l5_clean_resolve_links", PS.ext_links_sql(
    "page_id, CAST(pos AS BIGINT) AS pos, href, title, link_url AS url", "clean_links"))
def q_clean_links(spark, sf_dir):
    return _long(_ext_links(spark, sf_dir, "l5"), [("pos", "pos"), ("href", "href"), ("title", "title"),
                                                   ("url", "url")]).withColumn("pos", F.col("pos").cast("long"))


@register("l6_dedupe_links", PS.ext_links_sql(
    "page_id, CAST(pos AS BIGINT) AS pos, link_url AS url", "uniq_links"))
def q_dedupe_links(spark, sf_dir):
    return _long(_ext_links(spark, sf_dir, "l6"), [("pos", "pos"), ("url", "url")]).withColumn(
        "pos", F.col("pos").cast("long"))


@register("l7_registrable_domain", PS.ext_links_sql(
    f"page_id, CAST(pos AS BIGINT) AS pos, {PS.q.registrable_domain('link_url')} AS domain, "
    f"{PS.q.registrable_domain('page_url')} AS page_domain", "uniq_links"))
def q_registrable_domain(spark, sf_dir):
    from gazette.functions.urls import registrable_domain
    df = _ext_links(spark, sf_dir, "l6")
    return (df.select("page_id", "url", F.explode("links").alias("l"))
              .select("page_id", F.col("l.pos").cast("long").alias("pos"),
                      registrable_domain(F.col("l.url")).alias("domain"),
                      registrable_domain(F.col("url")).alias("page_domain")))


@register("l8_classify_links", PS.ext_links_sql(
    "page_id, CAST(pos AS BIGINT) AS pos, link_url AS url, link_class", "uniq_links"))
def q_classify_links(spark, sf_dir):
    return _long(_ext_links(spark, sf_dir, "l8"), [("pos", "pos"), ("url", "url"),
                                                   ("link_class", "link_class")]).withColumn(
        "pos", F.col("pos").cast("long"))


_LISTED = f"(SELECT count(*) FROM listed d WHERE {q.bare_host('link_url')} = d.domain OR suffix({q.bare_host('link_url')}, '.' || d.domain)) > 0"


@register("l8_live_aggregators", PS.ext_links_sql(
    "page_id, CAST(pos AS BIGINT) AS pos, link_url AS url, "
    + PS.link_class_sql("link_url", q.registrable_domain("page_url"), listed=_LISTED) + " AS link_class", "uniq_links").replace(
    "uniq_links AS (", f"""listed AS (SELECT DISTINCT {q.bare_host('link_url')} AS domain FROM clean_links WHERE pos % 3 = 1
           UNION SELECT '{DEFAULT_SITE.host}'),
uniq_links AS ("""))
def q_live_aggregators(spark, sf_dir):
    """L8 against a table of aggregators: the hosts of every third link of a page."""
    clean = _ext_links(spark, sf_dir, "l5")
    dim = clean.select(F.explode("links").alias("l")).filter("l.pos % 3 = 1").select(bare_host(F.col("l.url")).alias("domain"))
    df = L.classify_links(_ext_links(spark, sf_dir, "l6"), dim_aggregator=dim)
    return _long(df, [("pos", "pos"), ("url", "url"), ("link_class", "link_class")]).withColumn("pos", F.col("pos").cast("long"))


@register("l9_split_by_class", PS.ext_links_sql(
    "page_id, CAST(count(*) FILTER (WHERE link_class = 'official') AS BIGINT) AS n_official, "
    "CAST(count(*) FILTER (WHERE link_class <> 'official') AS BIGINT) AS skipped_count",
    "uniq_links", tail="GROUP BY page_id"))
def q_split_by_class(spark, sf_dir):
    df = L.split_by_class(_ext_links(spark, sf_dir, "l8"))
    return (df.filter(F.size("links") > 0)
              .select("page_id", F.size("official_links").cast("long").alias("n_official"),
                      F.col("skipped_count").cast("long")))


_N_ALL = "row_number() OVER (PARTITION BY page_id ORDER BY pos)"


@register("l10_title_links_server", PS.ext_links_sql(
    f"page_id, CAST({_N_ALL} AS BIGINT) AS n, link_url AS url, "
    f"{PS.title_server_sql('title', 'link_url', _N_ALL)} AS title", "uniq_links",
    tail="WHERE link_class = 'official'"))
def q_title_server(spark, sf_dir):
    df = L.title_links(L.split_by_class(_ext_links(spark, sf_dir, "l8")), "official_links", "server")
    return L.explode_links(df, "official_links", ["page_id"], ["url", "title"]).withColumn(
        "n", F.col("n").cast("long"))


@register("l11_title_links_client", PS.ext_links_sql(
    f"page_id, CAST({_N_ALL} AS BIGINT) AS n, link_url AS url, "
    f"{PS.title_client_sql('title', 'link_url', _N_ALL)} AS title, "
    f"{PS.link_kind_client_sql(PS.title_client_sql('title', 'link_url', _N_ALL))} AS kind", "uniq_links"))
def q_title_client(spark, sf_dir):
    df = L.title_links(_ext_links(spark, sf_dir, "l6"), "links", "client")
    out = L.explode_links(df, "links", ["page_id"], ["url", "title"])
    return out.select("page_id", F.col("n").cast("long").alias("n"), "url", "title",
                      L.link_kind_client(F.lower("title")).alias("kind"))


@register("l12_l13_title_kind_table", PS.ext_links_sql(
    f"page_id, CAST({_N_ALL} AS BIGINT) AS n, link_url AS url, "
    f"{PS.title_table_sql('raw_title', 'link_url', _N_ALL)} AS title, "
    f"{PS.link_kind_sql(PS.title_table_sql('raw_title', 'link_url', _N_ALL))} AS kind",
    "(SELECT u.*, c.raw_title FROM uniq_links u JOIN raw_links c USING (page_id, pos))"))
def q_title_table(spark, sf_dir):
    df = _ext_links(spark, sf_dir, "l6")
    df = df.withColumn("links", F.transform("links", lambda x: x.withField("title", x["raw_title"])))
    df = L.title_links(df, "links", "table")
    out = L.explode_links(df, "links", ["page_id"], ["url", "title"])
    return out.select("page_id", F.col("n").cast("long").alias("n"), "url", "title",
                      L.link_kind(F.lower("title")).alias("kind"))


@register("p1_extract_text", PS.ext_pages_sql(f"page_id, {PS.html_to_text_sql('html')} AS text"))
def q_extract_text(spark, sf_dir):
    return P.extract_text(_ext_ok(spark, sf_dir)).select("page_id", "text")  # noqa: E501


P2_MIN_BYTES = 1200  # between the shortest and the longest of the supplied pages, so that both branches occur


@register("p2_reject_short", f"""WITH {pages_ext_cte()}
texts AS (SELECT page_id, {PS.html_to_text_sql('html')} AS t FROM pages_ext)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS chars, strlen(t) >= {P2_MIN_BYTES} AS accepted FROM texts""")
def q_reject_short(spark, sf_dir):
    ok, bad = P.reject_short(P.extract_text(pages_ext(_pages(spark, sf_dir))), min_bytes=P2_MIN_BYTES)
    return (ok.withColumn("accepted", F.lit(True)).unionByName(bad.drop("reason").withColumn("accepted", F.lit(False)))
              .select("page_id", F.col("chars").cast("long").alias("chars"), "accepted"))


@register("p3_featured_image", PS.ext_pages_sql(
    f"page_id, {PS.featured_image_sql('html', 'url')} AS featured_image"))
def q_featured_image(spark, sf_dir):
    return P.with_featured_image(_ext_ok(spark, sf_dir)).select("page_id", "featured_image")


@register("p4_p5_title_type", PS.ext_pages_sql(
    f"page_id, {PS.page_title_sql('html')} AS page_title, "
    f"{PS.detect_type_sql('url', PS.page_title_sql('html'), 'html')} AS detected_type"))
def q_title_type(spark, sf_dir):
    df = P.with_detected_type(P.with_page_title(_ext_ok(spark, sf_dir)))
    return df.select("page_id", "page_title", "detected_type")


@register("p6_scrape_batch_ext", PS.page_facts_sql("pages_ext", prelude=pages_ext_cte()))
def q_scrape_batch_ext(spark, sf_dir):
    facts, _ = scrape_batch(pages_ext(_pages(spark, sf_dir)))
    return (facts.select("page_id", "url", "text", F.col("chars").cast("long").alias("chars"),
                         L.links_text(F.col("official_links")).alias("official_links"),
                         F.col("skipped_count").cast("long").alias("skipped_count"),
                         "featured_image", "page_title", "detected_type"))


@register("v8_link_class_counts", PS.ext_links_sql(
    f"{PS.q.registrable_domain('page_url')} AS source_domain, "
    "CAST(count(*) FILTER (WHERE link_class = 'official') AS BIGINT) AS n_official, "
    "CAST(count(*) FILTER (WHERE link_class = 'aggregator') AS BIGINT) AS n_aggregator, "
    "CAST(count(*) FILTER (WHERE link_class = 'unknown') AS BIGINT) AS n_unknown, "
    "CAST(count(DISTINCT page_id) AS BIGINT) AS n_pages",
    "uniq_links", tail=f"GROUP BY ROLLUP ({PS.q.registrable_domain('page_url')})"))
def q_link_class_counts(spark, sf_dir):
    from gazette.operators.validate import link_class_counts
    pages = _ext_links(spark, sf_dir, "l8").withColumnRenamed("_src_domain", "source_domain")
    return link_class_counts(pages, ["source_domain"], rollup=True)


_SETS = [["source_domain", "detected_type", "link_class"], ["source_domain", "link_class"], ["detected_type", "link_class"], ["link_class"], []]
_KEYED = PS.ext_links_sql(f"page_id, {PS.q.registrable_domain('page_url')} AS source_domain, link_class", "uniq_links")


@register("v8_link_class_sets", f"""
WITH l AS ({_KEYED}), f AS ({PS.page_facts_sql("pages_ext", prelude=pages_ext_cte())})
SELECT source_domain, detected_type, link_class, CAST(GROUPING(source_domain, detected_type, link_class) AS BIGINT) AS level,
       CAST(count(*) AS BIGINT) AS n_links
FROM l JOIN f USING (page_id) GROUP BY GROUPING SETS ({", ".join("(" + ", ".join(x) + ")" for x in _SETS)})""")
def q_link_class_sets(spark, sf_dir):
    """The links of accepted pages by domain, type and class; the pages come in two parts, whose counts are merged."""
    from gazette.operators.validate import link_class_parts, link_class_sets
    types = scrape_batch(pages_ext(_pages(spark, sf_dir)))[0].select("page_id", "detected_type")
    pages = _ext_links(spark, sf_dir, "l8").withColumnRenamed("_src_domain", "source_domain").join(types, "page_id")
    first = F.pmod("page_id", F.lit(2)) == 0
    keys = ["source_domain", "detected_type"]
    parts = link_class_parts(pages.filter(first), keys).unionByName(link_class_parts(pages.filter(~first), keys))
    return link_class_sets(parts, _SETS).drop("n_targets")

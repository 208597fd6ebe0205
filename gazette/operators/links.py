"""Link operators.

A page's links travel as one ``ARRAY<STRUCT>`` column next to the page, so
extraction, cleaning, resolution, validation, per-page dedupe and
classification are all higher-order-function transforms inside the same task
as the page row: the scrape needs no shuffle at all, whatever the number of
pages.  ``explode_links`` turns the array into the long table
``(page_id, pos, ...)`` where a report needs one row per link.

Posting link lists (``important_links``) use the same element shape
``STRUCT<title STRING, url STRING>`` and the same rule expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.config import DEFAULT_SITE, SiteConfig
from gazette.functions import rules
from gazette.functions.regex import alternation, java
from gazette.functions.text import decode_entities, is_numeric, last_of, let, php_trim, strip_tags
from gazette.functions.urls import (HAS_HTTP_RX, bare_host, is_valid_url, page_dir,
                                    registrable_domain, url_host, url_path, url_scheme)

# L1: anchors with a quoted href whose first character is not a quote, '#' or blank;
# the body is captured lazily up to the first </a>.
ANCHOR_RX = r"""<a[^>]+href=["']([^"'#\t\n\x0b\f\r ][^"']*)["'][^>]*>(.*?)</a>"""
NON_WEB_RX = r"^(mailto:|tel:|javascript:|#)"
OFFICIAL_HOST_RX = alternation(rules.OFFICIAL_HOST_PATTERNS)

LINK_FIELDS = ["pos", "raw_href", "raw_title", "title", "url"]


def _transform(df: DataFrame, name: str, fn) -> DataFrame:
    return df.withColumn(name, F.transform(F.col(name), fn))


def _filter(df: DataFrame, name: str, fn) -> DataFrame:
    return df.withColumn(name, F.filter(F.col(name), fn))


# ---------------------------------------------------------------- L1 .. L6 (per page)

def extract_links(pages: DataFrame, html: str = "html", out: str = "links") -> DataFrame:
    """L1: ``links`` = [{pos, raw_href, raw_title}] in document order (pos is 1-based).

    The page is scanned once for whole anchors; each (short) anchor is then
    re-matched for its two groups.  Linear in the page: nothing behind the last </a> can be an anchor, and where an
    opener is none, no other one in the same open tag is, so the scan passes over all of that tag."""
    rx = java(ANCHOR_RX, ci=True, dotall=True)
    scanned = last_of(F.col(html), "</a>")
    found = F.regexp_extract_all(scanned, F.lit(java(ANCHOR_RX + "|<a[^>]*+", ci=True, dotall=True)), 0)
    anchors = F.filter(found, lambda a: a.contains(">"))
    return pages.withColumn(out, F.transform(anchors, lambda a, i: F.struct(
        (i + 1).alias("pos"),
        F.regexp_extract(a, rx, 1).alias("raw_href"),
        F.regexp_extract(a, rx, 2).alias("raw_title"))))


def clean_anchor_text(df: DataFrame, links: str = "links") -> DataFrame:
    """L2: href trimmed and entity-decoded; title = trim(strip_tags(body))."""
    return _transform(df, links, lambda x: x
                      .withField("href", decode_entities(php_trim(x["raw_href"])))
                      .withField("title", php_trim(strip_tags(x["raw_title"]))))


def drop_non_web(df: DataFrame, links: str = "links") -> DataFrame:
    """L3: drop mailto:, tel:, javascript: and fragment-only hrefs."""
    rx = java(NON_WEB_RX, ci=True)
    return _filter(df, links, lambda x: ~x["href"].rlike(rx))


def resolve_href(href: Column, origin: Column, base_dir: Column) -> Column:
    """L4 rule for one href against a page (origin = scheme://host, base_dir = rtrim(dirname))."""
    return (F.when(href.rlike(HAS_HTTP_RX), href)
            .when(href.startswith("//"), F.concat(F.lit("https:"), href))
            .when(href.startswith("/"), F.concat(origin, href))
            .otherwise(F.concat(origin, base_dir, F.lit("/"), href)))


def with_page_context(df: DataFrame, page_url: str = "url") -> DataFrame:
    """Per-page values the link rules need, computed once per page."""
    u = F.col(page_url)
    return (df.withColumn("_origin", F.concat(url_scheme(u), F.lit("://"), url_host(u)))
              .withColumn("_dir", page_dir(u))
              .withColumn("_src_domain", registrable_domain(u)))


def resolve_links(df: DataFrame, links: str = "links") -> DataFrame:
    """L4: absolute URL per link (needs ``with_page_context``)."""
    return _transform(df, links, lambda x: x.withField(
        "url", resolve_href(x["href"], F.col("_origin"), F.col("_dir"))))


def filter_valid_urls(df: DataFrame, links: str = "links") -> DataFrame:
    """Keep syntactically valid http(s) URLs."""
    return _filter(df, links, lambda x: is_valid_url(x["url"]))


def dedupe_links(df: DataFrame, links: str = "links") -> DataFrame:
    """Per page, the first link for each lower-cased URL; document order kept.

    Sort by (key, pos), keep the first of each key, sort back by pos: O(n log n) per page,
    inside the page's own task (the sorted list is bound once, not sorted again per element)."""
    keyed = F.array_sort(F.transform(F.col(links), lambda x: F.struct(
        F.lower(x["url"]).alias("k"), x["pos"].alias("p"), x.alias("v"))))
    firsts = let(keyed, lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["k"] != x["k"])))
    back = F.array_sort(F.transform(firsts, lambda x: F.struct(x["p"].alias("p"), x["v"].alias("v"))))
    return df.withColumn(links, F.transform(back, lambda x: x["v"]))


# ---------------------------------------------------------------- L7 / L8

def aggregator_domains(site: SiteConfig = DEFAULT_SITE) -> list[str]:
    return rules.AGGREGATOR_DOMAINS + [site.host]


def host_suffixes(host: Column) -> Column:
    """'a.b.c' -> ['a.b.c', 'b.c', 'c'] (every label suffix)."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                       lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))


def is_aggregator(host: Column, source_domain: Column, site: SiteConfig = DEFAULT_SITE, listed: Column | None = None) -> Column:
    """Whether L8 calls a valid URL of this host an aggregator's: the source's own site, or a listed host."""
    if listed is None:
        listed = F.arrays_overlap(host_suffixes(host), F.array(*[F.lit(d) for d in aggregator_domains(site)]))
    same_site = (host == source_domain) | host.endswith(F.concat(F.lit("."), source_domain))
    return F.coalesce(same_site, F.lit(False)) | F.coalesce(listed, F.lit(False))


def link_class_of(url: Column, host: Column, source_domain: Column,
                  site: SiteConfig = DEFAULT_SITE, listed: Column | None = None) -> Column:
    """L8 rule for one URL (``host`` = lower host without www.), first rule wins.  ``listed``: whether
    the aggregator list holds the host, where it is looked up elsewhere (``with_listed_hosts``)."""
    return (F.when(~is_valid_url(url), F.lit("unknown"))
            .when(is_aggregator(host, source_domain, site, listed), F.lit("aggregator"))
            .when(host.rlike(java(OFFICIAL_HOST_RX, ci=True)), F.lit("official"))
            .when(F.lower(url_path(url)).endswith(".pdf"), F.lit("official"))
            .otherwise(F.lit("unknown")))


LITERAL_DOMAINS = 5_000  # a table of up to so many distinct domains is a set in the plan


def table_domains(dim_aggregator: DataFrame, site: SiteConfig = DEFAULT_SITE) -> DataFrame:
    """The distinct domains of a table of aggregators, and the site's own host."""
    own = dim_aggregator.sparkSession.range(1).select(F.lit(site.host).alias("_domain"))
    return dim_aggregator.select(F.lower(F.trim("domain")).alias("_domain")).filter("_domain <> ''").union(own).distinct()


def listed_in(dim_aggregator: DataFrame, site: SiteConfig = DEFAULT_SITE):
    """Whether a host is listed, as a function of its column, where the table is small enough for a set in the plan
    (hashed look-ups, no exchange); None where it is not (``with_listed_hosts`` then joins).  Reads the table up to the bound."""
    found = [r["_domain"] for r in table_domains(dim_aggregator, site).limit(LITERAL_DOMAINS + 1).collect()]
    if len(found) > LITERAL_DOMAINS:
        return None
    return lambda host: F.exists(host_suffixes(host), lambda d: d.isin(found))


def with_listed_hosts(df: DataFrame, hosts: Column, dim_aggregator: DataFrame, key: str, out: str,
                      site: SiteConfig = DEFAULT_SITE) -> DataFrame:
    """``out``: those of a row's ``hosts`` that the table (domain) lists, themselves or by a domain above them.

    Each distinct host is cut into its suffixes once and semi-joined with the table, so neither side's size matters;
    Spark broadcasts a side that it measures as small and puts its runtime Bloom filter before a large shuffle.  Only
    (key, host) pairs travel, not the rows' pages or texts, and what returns is grouped by ``key``, one list of listed
    hosts each.  Rows that share a key, or have none, share a list: being listed depends on the host alone."""
    domains = table_domains(dim_aggregator, site)
    pairs = df.select(F.col(key).alias("_of"), F.explode(F.array_distinct(hosts)).alias("_host"))
    suffixes = pairs.select("_host").distinct().select("_host", F.explode(host_suffixes(F.col("_host"))).alias("_domain"))
    listed = suffixes.join(domains, "_domain", "left_semi").select("_host").distinct()
    found = pairs.join(listed, "_host", "left_semi").groupBy("_of").agg(F.collect_set("_host").alias("_hosts"))
    return df.join(found, F.col(key).eqNullSafe(F.col("_of")), "left").withColumn(
        out, F.coalesce("_hosts", F.array().cast("array<string>"))).drop("_of", "_hosts")


def classify_links(df: DataFrame, links: str = "links", site: SiteConfig = DEFAULT_SITE, source_domain: str = "_src_domain",
                   dim_aggregator: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """L8 over an array of links (the page's registrable domain in ``source_domain``).  The aggregators are the
    fixed list, or with ``dim_aggregator`` (domain) the rows of that table, a set in the plan or by its counted size
    a join; the site's own host always is one."""
    df = _transform(df, links, lambda x: x.withField("host", bare_host(x["url"])))
    listed = None
    if dim_aggregator is not None:
        listed = listed_in(dim_aggregator, site)
        if listed is None:
            df = with_listed_hosts(df, F.transform(links, lambda x: x["host"]), dim_aggregator, key, "_listed", site)
            listed = lambda host: F.array_contains("_listed", host)
    df = _transform(df, links, lambda x: x.withField(
        "link_class", link_class_of(x["url"], x["host"], F.col(source_domain), site, listed and listed(x["host"]))))
    return df.drop("_listed")


def split_by_class(df: DataFrame, links: str = "links", out: str = "official_links") -> DataFrame:
    """Official links kept, ``skipped_count`` = aggregator + unknown."""
    return (df.withColumn(out, F.filter(F.col(links), lambda x: x["link_class"] == "official"))
              .withColumn("skipped_count", F.size(F.col(links)) - F.size(F.col(out))))


# ---------------------------------------------------------------- L10 .. L13 titles

def _first_rule(value: Column, rule_list, otherwise: Column, as_regex: bool = True) -> Column:
    expr = None
    for pattern, label in rule_list:
        cond = value.rlike(java(pattern, ci=True)) if as_regex else value.contains(pattern)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(otherwise)


# The title rules take t = trimmed title (never null) and lu = lower-cased url (never null),
# computed once by the caller, and n = 1-based position in the list at hand.

def title_server(t: Column, lu: Column, n: Column) -> Column:
    """Keep a real title, else a label from the URL, else 'Official Link n'."""
    generic = (t.rlike(r"^[0-9]+$") | t.rlike(java(rules.GENERIC_TITLE_SERVER, ci=True))
               | (F.char_length(t) < 3))
    label = _first_rule(lu, rules.LINK_TITLE_RULES_SERVER,
                        F.concat(F.lit(rules.LINK_TITLE_FALLBACK_SERVER), n.cast("string")))
    return F.when(~generic, t).otherwise(label)


def title_client(t: Column, lu: Column, n: Column) -> Column:
    """Client profile (5 generic words, 9 rules, 'Important Link n')."""
    generic = t.rlike(r"^[0-9]+$") | t.rlike(java(rules.GENERIC_TITLE_CLIENT, ci=True)) | (t == "")
    label = _first_rule(lu, rules.LINK_TITLE_RULES_CLIENT,
                        F.concat(F.lit(rules.LINK_TITLE_FALLBACK_CLIENT), n.cast("string")))
    return F.when(~generic, t).otherwise(label)


def title_table(t: Column, lu: Column, n: Column, raw: Column) -> Column:
    """Links-table profile, only for a missing/blank/numeric title (``raw`` kept otherwise)."""
    replace = raw.isNull() | (t == "") | is_numeric(t)
    label = _first_rule(lu, rules.LINK_TITLE_RULES_TABLE,
                        F.concat(F.lit(rules.LINK_TITLE_FALLBACK_TABLE), n.cast("string")),
                        as_regex=False)
    return F.when(replace, label).otherwise(raw)


def link_kind(lt: Column) -> Column:
    """Kind code from the first keyword contained in the lower title ``lt``."""
    return _first_rule(lt, rules.LINK_KIND_KEYWORDS, F.lit(rules.LINK_KIND_DEFAULT), as_regex=False)


def link_kind_client(lt: Column) -> Column:
    return _first_rule(lt, rules.LINK_KIND_RULES_CLIENT, F.lit(rules.LINK_KIND_DEFAULT))


def title_links(df: DataFrame, links: str, profile: str = "server") -> DataFrame:
    """L10/L11/L12 over an array of links; n is the 1-based position in that array."""
    df = _transform(df, links, lambda x: x
                    .withField("_t", php_trim(F.coalesce(x["title"], F.lit(""))))
                    .withField("_lu", F.lower(F.coalesce(x["url"], F.lit("")))))
    if profile == "server":
        fn = lambda x, i: title_server(x["_t"], x["_lu"], i + 1)
    elif profile == "client":
        fn = lambda x, i: title_client(x["_t"], x["_lu"], i + 1)
    else:
        fn = lambda x, i: title_table(x["_t"], x["_lu"], i + 1, x["title"])
    df = _transform(df, links, lambda x, i: x.withField("title", fn(x, i)))
    return _transform(df, links, lambda x: x.dropFields("_t", "_lu"))


def explode_links(df: DataFrame, links: str, keep: list[str], fields: list[str]) -> DataFrame:
    """Long table: one row per link, ``n`` = 1-based position in the array."""
    return (df.select(*keep, F.posexplode(F.col(links)).alias("_i", "_l"))
              .select(*keep, (F.col("_i") + 1).alias("n"), *[F.col("_l")[f].alias(f) for f in fields]))


# ---------------------------------------------------------------- page link pipeline

def page_links(pages: DataFrame, html: str = "html", url: str = "url",
               site: SiteConfig = DEFAULT_SITE, dim_aggregator: DataFrame | None = None) -> DataFrame:
    """L1..L8 in order: extract, clean, drop non-web, resolve, validate, dedupe, classify."""
    df = with_page_context(pages, url)
    df = extract_links(df, html)
    df = clean_anchor_text(df)
    df = drop_non_web(df)
    df = resolve_links(df)
    df = filter_valid_urls(df)
    df = dedupe_links(df)
    return classify_links(df, site=site, dim_aggregator=dim_aggregator)


def to_title_url(arr: Column) -> Column:
    """Project link structs to the published shape {title, url}."""
    return F.transform(arr, lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url")))


def links_text(arr: Column) -> Column:
    """A flat string form of a link list for reports and comparisons."""
    return F.array_join(F.transform(arr, lambda x: F.concat_ws(" <", x["title"], F.concat(x["url"], F.lit(">")))),
                        " | ")


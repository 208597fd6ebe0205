"""Oracle SQL (DuckDB) for the page and link operators.

Written independently of the Spark plan: one row per link via ``unnest``,
windows for first-by-key and numbering, ``CASE`` for the rule lists.  The only
shared pieces are the fixed rule values and the regex texts.
"""

from __future__ import annotations

from gazette.config import DEFAULT_SITE, SiteConfig
from gazette.functions import rules
from gazette.functions.regex import alternation
from gazette.oracle import sqlfn as q
from gazette.operators.links import ANCHOR_RX, NON_WEB_RX, OFFICIAL_HOST_RX
from gazette.operators import pages as P


def gated_pages_sql(src: str = "pages") -> str:
    """S1 over a relation with (page_id, url, html): adds reject_reason."""
    t = q.php_trim("coalesce(url, '')")
    fixed = q.with_scheme("coalesce(url, '')")
    return f"""
SELECT page_id, CASE WHEN {t} = '' THEN '' ELSE {fixed} END AS url, html,
       CASE WHEN {t} = '' THEN 'URL is required'
            WHEN NOT {q.is_valid_url(fixed)} THEN 'Invalid URL format' END AS reject_reason
FROM {src}"""


def first_rule_sql(value: str, rule_list, otherwise: str, as_regex: bool = True) -> str:
    parts = []
    for pattern, label in rule_list:
        cond = q.rlike(value, pattern, ci=True) if as_regex else f"contains({value}, {q.s(pattern)})"
        parts.append(f"WHEN {cond} THEN {q.s(label)}")
    return "(CASE " + " ".join(parts) + f" ELSE {otherwise} END)"


def title_server_sql(title: str, url: str, n: str) -> str:
    t = q.php_trim(f"coalesce({title}, '')")
    lu = f"lower(coalesce({url}, ''))"
    generic = (f"({q.rlike(t, '^[0-9]+$')} OR {q.rlike(t, rules.GENERIC_TITLE_SERVER, ci=True)}"
               f" OR length({t}) < 3)")
    label = first_rule_sql(lu, rules.LINK_TITLE_RULES_SERVER,
                           f"{q.s(rules.LINK_TITLE_FALLBACK_SERVER)} || CAST({n} AS VARCHAR)")
    return f"(CASE WHEN NOT {generic} THEN {t} ELSE {label} END)"


def title_client_sql(title: str, url: str, n: str) -> str:
    t = q.php_trim(f"coalesce({title}, '')")
    lu = f"lower(coalesce({url}, ''))"
    generic = (f"({q.rlike(t, '^[0-9]+$')} OR {q.rlike(t, rules.GENERIC_TITLE_CLIENT, ci=True)}"
               f" OR {t} = '')")
    label = first_rule_sql(lu, rules.LINK_TITLE_RULES_CLIENT,
                           f"{q.s(rules.LINK_TITLE_FALLBACK_CLIENT)} || CAST({n} AS VARCHAR)")
    return f"(CASE WHEN NOT {generic} THEN {t} ELSE {label} END)"


def title_table_sql(title: str, url: str, n: str) -> str:
    t = q.php_trim(f"coalesce({title}, '')")
    lu = f"lower(coalesce({url}, ''))"
    label = first_rule_sql(lu, rules.LINK_TITLE_RULES_TABLE,
                           f"{q.s(rules.LINK_TITLE_FALLBACK_TABLE)} || CAST({n} AS VARCHAR)",
                           as_regex=False)
    return f"(CASE WHEN {title} IS NULL OR {t} = '' OR {q.is_numeric(t)} THEN {label} ELSE {title} END)"


def link_kind_sql(title: str) -> str:
    return first_rule_sql(f"lower(coalesce({title}, ''))", rules.LINK_KIND_KEYWORDS,
                          q.s(rules.LINK_KIND_DEFAULT), as_regex=False)


def link_kind_client_sql(title: str) -> str:
    return first_rule_sql(f"lower(coalesce({title}, ''))", rules.LINK_KIND_RULES_CLIENT,
                          q.s(rules.LINK_KIND_DEFAULT))


def aggregator_list_sql(site: SiteConfig = DEFAULT_SITE) -> str:
    return "[" + ", ".join(q.s(d) for d in rules.AGGREGATOR_DOMAINS + [site.host]) + "]"


def link_class_sql(url: str, src_domain: str, site: SiteConfig = DEFAULT_SITE, listed: str | None = None) -> str:
    host = q.bare_host(url)
    listed = listed or (f"list_contains({aggregator_list_sql(site)}, {host}) "
                        f"OR len(list_filter({aggregator_list_sql(site)}, lambda d: suffix({host}, '.' || d))) > 0")
    return f"""(CASE WHEN NOT {q.is_valid_url(url)} THEN 'unknown'
      WHEN {host} = {src_domain} OR suffix({host}, '.' || {src_domain}) THEN 'aggregator'
      WHEN {listed} THEN 'aggregator'
      WHEN {q.rlike(host, OFFICIAL_HOST_RX, ci=True)} THEN 'official'
      WHEN suffix(lower({q.url_path(url)}), '.pdf') THEN 'official'
      ELSE 'unknown' END)"""


def resolve_sql(href: str, page_url: str) -> str:
    origin = f"({q.url_scheme(page_url)} || '://' || {q.url_host(page_url)})"
    return f"""(CASE WHEN {q.rlike(href, '^[Hh][Tt][Tt][Pp][Ss]?://')} THEN {href}
      WHEN starts_with({href}, '//') THEN 'https:' || {href}
      WHEN starts_with({href}, '/') THEN {origin} || {href}
      ELSE {origin} || {q.page_dir(page_url)} || '/' || {href} END)"""


def links_ctes(src: str = "gated", site: SiteConfig = DEFAULT_SITE) -> str:
    """CTEs raw_links (L1), clean_links (L2..L5), uniq_links (L6 + L8) over ``src``."""
    rx = q.rx(ANCHOR_RX, ci=True, dotall=True)
    return f"""
anchors AS (
  SELECT page_id, url, regexp_extract_all(html, {rx}, 1) AS hrefs,
         regexp_extract_all(html, {rx}, 2) AS titles
  FROM {src}),
raw_links AS (
  SELECT page_id, url AS page_url, unnest(range(1, len(hrefs) + 1)) AS pos,
         unnest(hrefs) AS raw_href, unnest(titles) AS raw_title
  FROM anchors),
decoded AS (
  SELECT page_id, page_url, pos, raw_href, raw_title,
         {q.decode_entities(q.php_trim('raw_href'))} AS href,
         {q.php_trim(q.strip_tags('raw_title'))} AS title
  FROM raw_links),
web_links AS (
  SELECT * FROM decoded WHERE NOT {q.rlike('href', NON_WEB_RX, ci=True)}),
resolved AS (
  SELECT *, {resolve_sql('href', 'page_url')} AS link_url FROM web_links),
clean_links AS (
  SELECT * FROM resolved WHERE {q.is_valid_url('link_url')}),
uniq_links AS (
  SELECT page_id, page_url, pos, title, link_url,
         {link_class_sql('link_url', q.registrable_domain('page_url'), site)} AS link_class
  FROM clean_links
  QUALIFY row_number() OVER (PARTITION BY page_id, lower(link_url) ORDER BY pos) = 1)"""


def html_to_text_sql(html: str) -> str:
    h = html
    for tag in ("script", "style", "noscript"):
        h = q.rrep(h, rf"<{tag}[^>]*>.*?</{tag}>", " ", ci=True, dotall=True)
    for tag in ("nav", "header", "footer", "aside", "iframe"):
        h = q.rrep(h, rf"<{tag}[^>]*>.*?</{tag}>", " ", ci=True, dotall=True)
    h = q.rrep(h, r"<!--.*?-->", " ", ci=True, dotall=True)
    h = q.rrep(h, P._BLOCK_OPEN, "\n", ci=True)
    h = q.rrep(h, P._BLOCK_CLOSE, "\n", ci=True)
    t = q.strip_tags(h)
    t = q.decode_entities(t)
    t = q.rrep(t, "[ \t]+", " ")
    t = q.rrep(t, "\n{3,}", "\n\n")
    t = q.php_trim(t)
    return t


def page_title_sql(html: str) -> str:
    t1 = q.rext(html, P._TITLE, ci=True)
    t2 = q.rext(html, P._OG_TITLE, ci=True)
    return f"(CASE WHEN {t1} <> '' THEN {q.php_trim(t1)} WHEN {t2} <> '' THEN {q.php_trim(t2)} ELSE '' END)"


def detect_type_sql(url: str, title: str, html: str) -> str:
    low = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    hay = (f"(translate({title} || ' ' || {html}, {low}) || ' ' || "
           f"lower({q.url_path(url)}))")
    parts = []
    for typ, words in rules.TYPE_KEYWORDS:
        cond = " OR ".join(f"contains(hay, {q.s(w)})" for w in words)
        parts.append(f"WHEN {cond} THEN {q.s(typ)}")
    return f"(SELECT CASE {' '.join(parts)} ELSE {q.s(rules.TYPE_DEFAULT)} END FROM (SELECT {hay} AS hay))"


def featured_image_sql(html: str, url: str) -> str:
    og1 = q.rext(html, P._OG_IMAGE_1, ci=True)
    og2 = q.rext(html, P._OG_IMAGE_2, ci=True)
    tw = q.rext(html, P._TW_IMAGE, ci=True)
    first = f"(CASE WHEN {og1} <> '' THEN {q.php_trim(og1)} WHEN {og2} <> '' THEN {q.php_trim(og2)} ELSE '' END)"
    second = f"(CASE WHEN {q.is_blank_str('fi1')} AND {tw} <> '' THEN {q.php_trim(tw)} ELSE fi1 END)"
    scheme = f"(CASE WHEN {q.url_scheme(url)} <> '' THEN {q.url_scheme(url)} ELSE 'https' END)"
    img = q.rx(P._IMG_SRC, ci=True)
    resolve = (f"lambda s: CASE WHEN s = '' OR contains(s, 'data:') OR contains(s, 'logo') OR contains(s, 'icon')"
               f" OR contains(s, 'banner') THEN NULL"
               f" WHEN {q.rlike('s', '^[Hh][Tt][Tt][Pp][Ss]?://')} THEN s"
               f" WHEN starts_with(s, '//') THEN {scheme} || ':' || s"
               f" WHEN starts_with(s, '/') THEN {scheme} || '://' || {q.url_host(url)} || s END")
    usable = (f"list_filter(list_transform(list_transform(regexp_extract_all({html}, {img}, 1), "
              f"lambda s: {q.php_trim('s')}), {resolve}), "
              f"lambda s: s IS NOT NULL AND NOT {q.rlike('s', P._GIF_SVG, ci=True)})")
    third = f"(CASE WHEN {q.is_blank_str('fi2')} THEN coalesce({usable}[1], fi2) ELSE fi2 END)"
    final = f"(CASE WHEN NOT {q.is_blank_str('fi3')} AND NOT {q.is_valid_url('fi3')} THEN '' ELSE fi3 END)"
    return (f"(SELECT {final} FROM (SELECT {third} AS fi3 FROM (SELECT {second} AS fi2 FROM "
            f"(SELECT {first} AS fi1))))")


def page_facts_sql(src: str = "pages", site: SiteConfig = DEFAULT_SITE, prelude: str = "") -> str:
    """P6 oracle: one row per accepted page, official links flattened to text."""
    text = html_to_text_sql("html")
    return f"""WITH {prelude}
gated AS ({gated_pages_sql(src)}),
ok AS (SELECT page_id, url, html FROM gated WHERE reject_reason IS NULL),
{links_ctes('ok', site)},
official AS (
  SELECT page_id, pos, link_url,
         {title_server_sql('title', 'link_url', 'row_number() OVER (PARTITION BY page_id ORDER BY pos)')} AS title
  FROM uniq_links WHERE link_class = 'official'),
official_agg AS (
  SELECT page_id, string_agg(title || ' <' || link_url || '>', ' | ' ORDER BY pos) AS official_links
  FROM official GROUP BY page_id),
counts AS (
  SELECT page_id, count(*) FILTER (WHERE link_class <> 'official') AS skipped_count
  FROM uniq_links GROUP BY page_id),
texts AS (
  SELECT page_id, url, html, {text} AS t0 FROM ok),
facts AS (
  SELECT page_id, url,
         t0 AS text,
         {page_title_sql('html')} AS page_title,
         {featured_image_sql('html', 'url')} AS featured_image,
         html
  FROM texts)
SELECT f.page_id, f.url, f.text, CAST(strlen(f.text) AS BIGINT) AS chars,
       coalesce(o.official_links, '') AS official_links,
       CAST(coalesce(c.skipped_count, 0) AS BIGINT) AS skipped_count,
       f.featured_image, f.page_title,
       {detect_type_sql('f.url', 'f.page_title', 'f.html')} AS detected_type
FROM facts f LEFT JOIN official_agg o USING (page_id) LEFT JOIN counts c USING (page_id)
WHERE strlen(f.text) >= {rules.TEXT_MIN_BYTES}"""


# ---------------------------------------------------------------- per-operator oracles on pages_ext

def ext_links_sql(select: str, stage: str, site: SiteConfig = DEFAULT_SITE, tail: str = "") -> str:
    from gazette.oracle.fixtures_sql import pages_ext_cte
    return f"""WITH {pages_ext_cte()}
gated AS ({gated_pages_sql('pages_ext')}),
ok AS (SELECT page_id, url, html FROM gated WHERE reject_reason IS NULL),
{links_ctes('ok', site)}
SELECT {select} FROM {stage} {tail}"""


def ext_pages_sql(select: str) -> str:
    from gazette.oracle.fixtures_sql import pages_ext_cte
    return f"""WITH {pages_ext_cte()}
gated AS ({gated_pages_sql('pages_ext')}),
ok AS (SELECT page_id, url, html FROM gated WHERE reject_reason IS NULL)
SELECT {select} FROM ok"""

"""URL column helpers.

Validity is one shared pattern (the same text runs in Spark and in the DuckDB
oracle) that follows the source tool's validator for http(s) URLs: only the
ASCII characters a URL may carry, a host of dot-separated labels made of
letters, digits and inner hyphens (no underscore), an optional numeric port.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions import rules
from gazette.functions.text import col, php_trim

# characters a URL may hold at all (anything else makes it invalid)
_ALLOWED = r"A-Za-z0-9$_.+!*'(),{}|\\^~\[\]`<>#%\";/?:@&=-"
_USERINFO = r"A-Za-z0-9$_.+!*'(),{}|\\^~\[\]`<>%\";:&=-"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
URL_VALID_RX = (
    r"^[Hh][Tt][Tt][Pp][Ss]?://"
    rf"(?:[{_USERINFO}]*@)?"
    rf"{_LABEL}(?:\.{_LABEL})*\.?"
    r"(?::[0-9]*)?"
    rf"(?:[/?#][{_ALLOWED}]*)?$"
)
HAS_HTTP_RX = r"^[Hh][Tt][Tt][Pp][Ss]?://"
SCHEME_RX = r"^([A-Za-z][A-Za-z0-9+.-]*)://"
HOST_RX = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH_RX = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
QUERY_RX = r"^[^?#]*\?([^#]*)"


def is_valid_url(c) -> Column:
    return F.coalesce(col(c).rlike(URL_VALID_RX), F.lit(False))


def url_scheme(c) -> Column:
    return F.regexp_extract(col(c), SCHEME_RX, 1)


def url_host(c) -> Column:
    return F.regexp_extract(col(c), HOST_RX, 1)


def url_path(c) -> Column:
    return F.regexp_extract(col(c), PATH_RX, 1)


def url_query(c) -> Column:
    return F.regexp_extract(col(c), QUERY_RX, 1)


def bare_host(c) -> Column:
    """Lower-cased host with a leading ``www.`` removed."""
    return F.regexp_replace(F.lower(url_host(c)), r"^www\.", "")


def registrable_domain_of_host(host: Column) -> Column:
    parts = F.split(host, r"\.")
    n = F.size(parts)
    last2 = F.array_join(F.slice(parts, -2, 2), ".")
    last3 = F.array_join(F.slice(parts, -3, 3), ".")
    suffixes = F.array(*[F.lit(s) for s in rules.SECOND_LEVEL_SUFFIXES])
    return (F.when((n >= 3) & F.array_contains(suffixes, last2), last3)
            .when(n >= 2, last2)
            .otherwise(host))


def registrable_domain(url) -> Column:
    """Registrable domain of a URL."""
    return registrable_domain_of_host(bare_host(url))


def with_scheme(c) -> Column:
    """Trim; prefix ``https://`` (after dropping leading slashes) when there is no http(s) scheme."""
    return schemed(php_trim(c))


def schemed(t: Column) -> Column:
    """``with_scheme`` of a trimmed value."""
    return F.when(t.rlike(HAS_HTTP_RX), t).otherwise(
        F.concat(F.lit("https://"), F.regexp_replace(t, "^/+", "")))


def page_dir(url) -> Column:
    """rtrim(dirname(path ?: '/'), '/') of a page URL."""
    p = F.regexp_replace(url_path(url), "/+$", "")
    d = F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    return F.regexp_replace(d, "/+$", "")


def is_apply_url_bare(url) -> Column:
    """Home page with no query: rtrim(path,'/') blank and no query string."""
    path = F.regexp_replace(url_path(url), "/+$", "")
    return (path == "") & (url_query(url) == "")

"""DuckDB SQL spellings of the column helpers (for the differential oracle).

Each function takes a SQL expression string and returns one.  Patterns are the
same text as on the Spark side, passed through ``regex.re2``.
"""

from __future__ import annotations

import functools

from gazette.functions import rules
from gazette.functions.regex import re2, sql_str
from gazette.functions.text import ENTITY_RX, LEADING_NUM_RX, NUMERIC_RX, TAG_RX, named_entities
from gazette.functions.urls import (HAS_HTTP_RX, HOST_RX, PATH_RX, QUERY_RX, SCHEME_RX,
                                    URL_VALID_RX)

PHP_BLANKS_SQL = "chr(32)||chr(9)||chr(10)||chr(13)||chr(0)||chr(11)"


def s(text: str) -> str:
    return sql_str(text)


def rx(pattern: str, ci: bool = False, dotall: bool = False) -> str:
    return sql_str(re2(pattern, ci, dotall))


def rlike(e: str, pattern: str, ci: bool = False, dotall: bool = False) -> str:
    return f"regexp_matches({e}, {rx(pattern, ci, dotall)})"


def rext(e: str, pattern: str, group: int = 1, ci: bool = False, dotall: bool = False) -> str:
    return f"regexp_extract({e}, {rx(pattern, ci, dotall)}, {group})"


def rrep(e: str, pattern: str, repl: str, ci: bool = False, dotall: bool = False) -> str:
    return f"regexp_replace({e}, {rx(pattern, ci, dotall)}, {s(repl)}, 'g')"


def php_trim(e: str) -> str:
    return f"trim({e}, {PHP_BLANKS_SQL})"


def strip_tags(e: str) -> str:
    return rrep(e, TAG_RX, "")


@functools.cache
def _named() -> str:
    return "MAP {" + ", ".join(f"{s(k)}: {s(v)}" for k, v in named_entities().items()) + "}"


def decode_entities(e: str) -> str:
    """The text between the references, each followed by its decoded reference."""
    ent = f"regexp_extract_all({e}, {s(ENTITY_RX)})[i]"
    digits = f"regexp_extract({ent}, '([0-9a-fA-F]+);$', 1)"
    cp = f"(CASE WHEN lower({ent}[3]) = 'x' THEN ('0x' || {digits})::BIGINT ELSE {digits}::BIGINT END)"
    ok = (f"(({cp} BETWEEN 32 AND 126 OR {cp} IN (9, 10, 12) OR {cp} >= 160) AND {cp} <= 1114111 AND {cp} NOT BETWEEN 55296 AND 57343"
          f" AND {cp} NOT BETWEEN 64976 AND 65007 AND {cp} % 65536 < 65534)")
    one = (f"(CASE WHEN {ent} IS NULL THEN '' WHEN starts_with({ent}, '&#') THEN CASE WHEN {ok} THEN chr({cp}::INTEGER) ELSE {ent} END "
           f"ELSE coalesce({_named()}[{ent}], {ent}) END)")
    parts = f"string_split_regex({e}, {s(ENTITY_RX)})"
    return (f"(CASE WHEN regexp_matches({e}, {s(ENTITY_RX)}) THEN "
            f"array_to_string(list_transform({parts}, lambda part, i: part || {one}), '') ELSE {e} END)")


def is_blank_str(e: str) -> str:
    return f"({e} IS NULL OR {e} = '' OR {e} = '0')"


def nz(e: str) -> str:
    return f"coalesce({e}, '')"


def is_numeric(e: str) -> str:
    return f"coalesce({rlike(e, NUMERIC_RX)}, false)"


def leading_int(e: str) -> str:
    num = rext(e, LEADING_NUM_RX)
    return (f"coalesce(CASE WHEN {num} <> '' THEN TRY_CAST(trunc(TRY_CAST({num} AS DOUBLE)) AS BIGINT) END,"
            f" 0::BIGINT)")


def octets(e: str) -> str:
    return f"strlen({e})"


def is_valid_url(e: str) -> str:
    return f"coalesce({rlike(e, URL_VALID_RX)}, false)"


def url_scheme(e: str) -> str:
    return rext(e, SCHEME_RX)


def url_host(e: str) -> str:
    return rext(e, HOST_RX)


def url_path(e: str) -> str:
    return rext(e, PATH_RX)


def url_query(e: str) -> str:
    return rext(e, QUERY_RX)


def bare_host(e: str) -> str:
    return rrep(f"lower({url_host(e)})", r"^www\.", "")


def registrable_domain_of_host(h: str) -> str:
    parts = f"string_split({h}, '.')"
    last2 = f"array_to_string(list_slice({parts}, -2, -1), '.')"
    last3 = f"array_to_string(list_slice({parts}, -3, -1), '.')"
    suffixes = "[" + ", ".join(s(x) for x in rules.SECOND_LEVEL_SUFFIXES) + "]"
    return (f"(CASE WHEN len({parts}) >= 3 AND list_contains({suffixes}, {last2}) THEN {last3} "
            f"WHEN len({parts}) >= 2 THEN {last2} ELSE {h} END)")


def registrable_domain(e: str) -> str:
    return registrable_domain_of_host(bare_host(e))


def with_scheme(e: str) -> str:
    t = php_trim(e)
    return (f"(CASE WHEN {rlike(t, HAS_HTTP_RX)} THEN {t} "
            f"ELSE 'https://' || {rrep(t, '^/+', '')} END)")


def page_dir(e: str) -> str:
    p = rrep(url_path(e), "/+$", "")
    d = rext(p, r"^(.*)/[^/]*$")
    return rrep(d, "/+$", "")


def is_apply_url_bare(e: str) -> str:
    path = rrep(url_path(e), "/+$", "")
    return f"({path} = '' AND {url_query(e)} = '')"


def byte_cut(e: str, n: int) -> str:
    """First n UTF-8 bytes; a character split by the cut is dropped."""
    head = f"left({e}, {n})"
    return (f"(CASE WHEN strlen({e}) <= {n} THEN {e} ELSE array_to_string(list_filter("
            f"string_split({head}, ''), lambda ch, i: strlen(left({head}, i)) <= {n}), '') END)")

"""Text column helpers (all JVM-side built-ins, no Python per row)."""

from __future__ import annotations

import functools
import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# the blank set of PHP trim(): space, tab, newline, carriage return, NUL, vertical tab
PHP_BLANKS = " \t\n\r\x00\x0b"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def php_trim(c) -> Column:
    return F.btrim(col(c), F.lit(PHP_BLANKS))


def php_rtrim(c, chars: str) -> Column:
    return F.regexp_replace(col(c), "[" + "".join("\\" + ch for ch in chars) + "]+$", "")


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once per row however often ``fn`` reads it (also inside
    the lambdas of higher-order functions, which would otherwise evaluate it per element)."""
    return F.get(F.transform(F.array(value), fn), 0)


# A tag opens with '<' and a non-blank; quoted attribute values may hold '>'.  The possessive form
# (Java) never backtracks; the plain form (RE2, linear anyway) matches the same texts.
_TAG_START = r"""<[^ \t\n\r\x0b\f"'>]"""
TAG_RX = _TAG_START + r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>"""
TAG_RX_JAVA = _TAG_START + r"""[^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+>"""


def strip_tags(c) -> Column:
    return F.regexp_replace(col(c), TAG_RX_JAVA, "")


def last_of(text: Column, rx: str) -> Column:
    """``text`` up to and with its last match of ``rx`` ('' without one), found from its end."""
    return F.regexp_extract(text, rf"(?is)^.*{rx}", 0)


_SPARE = "\ufdd0\ufdd1\ufdd2\ufdd3"  # non-characters


def replace_blocks(text: Column, rx: str, by: str, blocks: list[tuple[str, str]]) -> Column:
    """``regexp_replace(text, rx, by)`` in linear time, for a lazy ``rx`` that runs from an opener to its closer.

    From an opener without a closer such a pattern reads to the end of the text and fails, and then again from the
    next one.  ``blocks`` are pairs: what an opener starts with, and its closer (``rx`` must need the opener's first
    letters as they are).  Openers that can only fail - behind the last closer, or in a tag that is still open where it
    starts - are taken apart with a character that the text does not hold before the pattern runs, and put together after it."""
    def upto(t: Column, opener: str, closer: str) -> Column:
        tag = opener.startswith("<") and opener[1:].isalnum()  # it needs its own '>' before the closer
        return last_of(t, rf">(?=[^>]*?{closer})") if tag else last_of(t, rf"(?={closer})")

    def taken_apart(t: Column, opener: str, closer: str, spare: Column) -> Column:
        return F.when(t.rlike("(?i)" + opener), let(F.length(upto(t, opener, closer)), lambda n: F.concat(
            F.substring(t, F.lit(1), n), F.regexp_replace(F.substring(t, n + 1, F.length(t)), F.lit(f"(?i)(?={opener})(.)"),
                                                         F.concat(F.lit("$1"), spare))))).otherwise(t)

    def whole(t: Column) -> Column:
        spare = F.coalesce(F.get(F.filter(F.array(*[F.lit(c) for c in _SPARE]), lambda c: ~t.contains(c)), 0), F.lit(""))
        return let(spare, lambda s: replaced(t, s))

    def replaced(t: Column, spare: Column, rest=None) -> Column:
        rest = blocks if rest is None else rest
        if rest:
            return let(taken_apart(t, *rest[0], spare), lambda u: replaced(u, spare, rest[1:]))
        return F.replace(F.regexp_replace(t, rx, by), spare, F.lit(""))

    some = "|".join(sorted({opener for opener, _ in blocks}))
    return let(text, lambda t: F.when(t.rlike(f"(?i){some}"), whole(t)).otherwise(t))


ENTITY_RX = "&(?:#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});"


@functools.cache
def named_entities() -> dict[str, str]:
    """Every named HTML5 character reference ('&name;' -> text), from the standard library's table;
    the ones pages use most come first, because a map literal is searched in order."""
    table = {f"&{k}": v for k, v in html.entities.html5.items() if k.endswith(";")}
    common = ["&amp;", "&nbsp;", "&quot;", "&lt;", "&gt;", "&apos;", "&rsquo;", "&lsquo;", "&rdquo;", "&ldquo;",
              "&ndash;", "&mdash;", "&hellip;", "&bull;", "&middot;", "&copy;", "&reg;", "&trade;"]
    return {k: table[k] for k in common} | table


def code_point_allowed(cp) -> list:
    """The code points a numeric reference may name (HTML5): no controls but tab, newline and form
    feed, no surrogates, no non-characters."""
    return [((cp >= 0x20) & (cp <= 0x7E)) | (cp == 9) | (cp == 10) | (cp == 12) | (cp >= 0xA0),
            cp <= 0x10FFFF, (cp < 0xD800) | (cp > 0xDFFF), (cp < 0xFDD0) | (cp > 0xFDEF),
            cp % 0x10000 < 0xFFFE]


def _decode_entity(e: Column) -> Column:
    named = F.from_json(F.lit(json.dumps(named_entities())), "map<string,string>")
    hexa = F.lower(F.substring(e, 3, 1)) == "x"
    digits = F.when(hexa, F.regexp_extract(e, "([0-9a-fA-F]+);$", 1)).otherwise(F.regexp_extract(e, "([0-9]+);$", 1))

    def char(cp):
        ok = functools.reduce(lambda a, b: a & b, code_point_allowed(cp))
        return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32"))

    number = F.when(hexa, F.conv(digits, 16, 10)).otherwise(digits)
    return F.coalesce(F.when(e.startswith("&#"), let(number.cast("long"), char)).otherwise(F.element_at(named, e)), e)


def decode_entities(c) -> Column:
    """Named and numeric character references decoded in one pass (an unknown one stays as it is)."""
    def joined(t):
        return let(F.regexp_extract_all(t, F.lit(ENTITY_RX), 0), lambda ents: F.array_join(F.transform(
            F.split(t, ENTITY_RX, -1),
            lambda s, i: F.concat(s, F.when(i < F.size(ents), _decode_entity(F.get(ents, i))).otherwise(F.lit("")))), ""))
    return let(col(c), lambda t: F.when(t.contains("&") & t.contains(";"), joined(t)).otherwise(t))


def is_blank_str(c) -> Column:
    """PHP empty() on a string: null, '' or '0'."""
    c = col(c)
    return c.isNull() | (c == "") | (c == "0")


def nz(c) -> Column:
    """String or '' when null."""
    return F.coalesce(col(c), F.lit(""))


_WS = r"[ \t\n\r\x0b\f]*"
_NUM = r"[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
NUMERIC_RX = "^" + _WS + _NUM + _WS + "$"
LEADING_NUM_RX = "^" + _WS + "(" + _NUM + ")"


def is_numeric(c) -> Column:
    """PHP is_numeric() on a string."""
    return col(c).rlike(NUMERIC_RX)


def leading_int(c) -> Column:
    """PHP (int) cast of a string: leading blanks, then the leading number (exponent allowed),
    truncated toward zero; 0 when there is none."""
    num = F.regexp_extract(col(c), LEADING_NUM_RX, 1)
    return F.coalesce(F.when(num != "", num.try_cast("double").try_cast("long")), F.lit(0).cast("long"))


def byte_cut(c, max_bytes: int) -> Column:
    """The longest prefix of at most ``max_bytes`` UTF-8 bytes (a character split by the cut is
    dropped).  Texts that fit are returned as they are; otherwise one fold over the first
    ``max_bytes`` characters finds how many fit."""
    s = col(c)
    head = F.substring(s, 1, max_bytes)

    def step(acc, ch):
        nb = acc["b"] + F.octet_length(ch)
        fits = ~acc["stop"] & (nb <= max_bytes)
        return F.struct(F.when(fits, nb).otherwise(acc["b"]).alias("b"),
                        F.when(fits, acc["k"] + 1).otherwise(acc["k"]).alias("k"),
                        (~fits).alias("stop"))

    init = F.struct(F.lit(0).alias("b"), F.lit(0).alias("k"), F.lit(False).alias("stop"))
    k = F.aggregate(F.split(head, ""), init, step, lambda a: a["k"])
    return (F.when(F.octet_length(s) <= max_bytes, s)
            .when(F.octet_length(head) <= max_bytes, head)
            .otherwise(F.substring(head, F.lit(1), k)))


ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c) -> Column:
    """Lower-case A-Z only (byte-length preserving, like the source's strtolower)."""
    return F.translate(col(c), ASCII_UPPER, ASCII_LOWER)


def octets(c) -> Column:
    return F.octet_length(col(c))


def empty_strs() -> Column:
    return F.array().cast("array<string>")


def empty_links() -> Column:
    return F.array().cast("array<struct<title:string,url:string>>")


def empty_faq() -> Column:
    return F.array().cast("array<struct<question:string,answer:string>>")

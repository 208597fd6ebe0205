"""Model responses (S3, S4): fenced, possibly truncated JSON text -> typed postings.

Parsing is the JVM's JSON reader (``try_parse_json`` to test, ``from_json`` to
type).  Only rows whose first parse fails go through the repair fold, so the
character scan costs nothing for well-formed answers.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions.regex import java
from gazette.functions.text import let, php_trim
from gazette.session import once

# Every field a response may carry; scalars stay strings (the model may put numbers or
# text anywhere), lists are typed.
RESPONSE_FIELDS = [
    "title", "type", "short_description", "content", "organization", "state_name", "category_name",
    "notification_date", "start_date", "end_date", "last_date", "deadline_time", "interview_date_from",
    "interview_date_to", "waitlist_date", "is_date_extended", "total_posts", "vacancy_gen", "vacancy_obc",
    "vacancy_sc", "vacancy_st", "vacancy_ews", "vacancy_ph", "salary", "salary_min", "salary_max",
    "salary_type", "online_form", "apply_url", "age_min", "age_max_gen", "age_max_obc", "age_max_sc",
    "age_max_ph", "age_max_ex_serviceman", "age_as_on_date", "age_relaxation_note", "notification_pdf",
    "gate_note", "fee_general", "fee_obc", "fee_sc_st", "fee_women", "fee_ph", "meta_title",
    "meta_description", "meta_keywords", "qualifications", "skills", "responsibilities", "post_name",
]
RESPONSE_SCHEMA = (", ".join(f"`{f}` string" for f in RESPONSE_FIELDS)
                   + ", selection_stages array<string>, tags array<string>, education array<string>,"
                     " important_links string, faq array<struct<question:string,answer:string>>")

FENCE_RX = "```json|```"


def strip_fences(body) -> Column:
    """Every fence marker removed (case-insensitive), then trimmed."""
    b = F.col(body) if isinstance(body, str) else body
    return php_trim(F.regexp_replace(b, java(FENCE_RX, ci=True), ""))


ALLOW_DUPLICATE_KEYS = "spark.sql.variant.allowDuplicateKeys"


@contextlib.contextmanager
def last_key_wins(spark: SparkSession):
    """Of equal keys in an object the last one counts, in what is analysed inside the block."""
    was = spark.conf.get(ALLOW_DUPLICATE_KEYS)
    spark.conf.set(ALLOW_DUPLICATE_KEYS, "true")
    try:
        yield
    finally:
        spark.conf.set(ALLOW_DUPLICATE_KEYS, was)


def parse_object(text: Column) -> Column:
    """A VARIANT of {"v": <object>} when the whole text is one JSON object, else null.

    The parser stops after the first value, so the text is parsed inside an object (which trailing
    text breaks, but for a further ``}``) and counted inside an array (which a further ``}`` breaks)."""
    whole = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return F.when(text.startswith("{") & whole, F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))))


def is_json_object(text: Column) -> Column:
    return parse_object(text).isNotNull()


# the only tokens that can change the repair state: a backslash with the character after it,
# and the quote / bracket characters (every other character is skipped by the scan)
REPAIR_TOKENS_RX = r'(?s)\\.|["{}\[\]]'
# a closed string, or the one that is open at the end, of which the quote is kept
STRINGS_RX = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|(")[^"\\]*+(?:\\.[^"\\]*+)*+\\?+\z'


def repair_truncated_json(text) -> Column:
    """Close a cut-off JSON text.  Trailing commas/blanks are dropped; one pass tracks
    (inside a string, pending closers); an open string is closed, then the pending closers are
    appended innermost first.

    Closed strings, and brackets that close at once, are taken out first (they leave the state as it is), so that
    the pass folds over what is still open and not over every character: a backslash inside a string consumes the
    next character, outside a string it is ignored and the next character counts on its own."""
    whole = F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"(?<![, ])[, ]++$", "")
    return let(whole, _repaired)


def _repaired(s: Column) -> Column:
    left = F.regexp_replace(F.regexp_replace(s, STRINGS_RX, "$1"), r'[^"{}\[\]]++', "")
    for _ in range(4):  # what is nested deeper is folded
        left = F.regexp_replace(left, r"[{\[][}\]]", "")
    toks = F.regexp_extract_all(left, F.lit(REPAIR_TOKENS_RX), 0)
    init = F.struct(F.lit(False).alias("in_str"), F.lit("").alias("stack"))

    def st(in_str, stack):
        return F.struct(in_str.alias("in_str"), stack.alias("stack"))

    def step(acc, tok):
        ch = F.when(F.length(tok) == 2, F.substring(tok, 2, 1)).otherwise(tok)
        stack = acc["stack"]
        return (F.when((F.length(tok) == 2) & acc["in_str"], acc)              # escape pair in a string
                .when(ch == '"', st(~acc["in_str"], stack))
                .when(acc["in_str"], acc)
                .when(ch == "{", st(F.lit(False), F.concat(stack, F.lit("}"))))
                .when(ch == "[", st(F.lit(False), F.concat(stack, F.lit("]"))))
                .when((ch == "}") | (ch == "]"),
                      st(F.lit(False), F.substring(stack, F.lit(1), F.greatest(F.length(stack) - 1, F.lit(0)))))
                .otherwise(acc))

    def finish(acc):
        return F.concat(s, F.when(acc["in_str"], F.lit('"')).otherwise(F.lit("")), F.reverse(acc["stack"]))

    return F.aggregate(toks, init, step, finish)


LIST_FIELDS = [("selection_stages", "array<string>"), ("tags", "array<string>"), ("education", "array<string>"),
               ("faq", "array<struct<question:string,answer:string>>")]


def read_responses(responses: DataFrame, body: str = "body") -> DataFrame:
    """S3: (all input columns, parse_status, parsed fields...).  ``parse_status`` is 'parsed',
    'repaired' or 'rejected'; rejected rows keep null fields.

    Each text is parsed once into a VARIANT (the repaired text only when the first parse
    fails); fields are read from the variant, scalars as their text, lists typed."""
    with last_key_wins(responses.sparkSession):
        df = responses.withColumn("_clean", strip_fences(body))
        df = once(df, "_v1", parse_object(F.col("_clean")))
        df = df.withColumn("_fixed", F.when(F.col("_v1").isNull(), repair_truncated_json(F.col("_clean"))))
        df = once(df, "_v2", F.when(F.col("_v1").isNull(), parse_object(F.col("_fixed"))))
    status = (F.when(F.col("_v1").isNotNull(), F.lit("parsed")).when(F.col("_v2").isNotNull(), F.lit("repaired"))
              .otherwise(F.lit("rejected")))
    df = df.withColumn("parse_status", status).withColumn("_v", F.coalesce("_v1", "_v2"))

    def get(field, typ):
        return F.try_variant_get(F.col("_v"), f"$.v.{field}", typ)

    cols = [get(f, "string").alias(f) for f in RESPONSE_FIELDS]
    cols += [get(f, t).alias(f) for f, t in LIST_FIELDS]
    cols.append(F.when(F.col("_v").isNotNull(), F.to_json(get("important_links", "variant")))
                .alias("important_links"))
    return df.select(*responses.columns, "parse_status", *cols)


def split_responses(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed, rejects), split by filters on the status; the parse stays below them and runs once."""
    ok = parsed.filter(F.col("parse_status") != "rejected")
    bad = (parsed.filter(F.col("parse_status") == "rejected")
                 .withColumn("reject_reason", F.lit("Failed to parse AI response")))
    return ok, bad

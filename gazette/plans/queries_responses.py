"""Registered queries over the derived model responses (B3): S3, S4, L14, V4."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette.oracle import fixtures_sql as FS
from gazette.oracle import sqlfn as q
from gazette.plans.fixtures import load_responses
from gazette.plans.registry import register
from gazette.session import once
from gazette.sources import responses as RS


def _resp_sql(select: str, tail: str = "") -> str:
    return f"WITH {FS.postings_raw_cte()}\n{FS.responses_cte()}\nbase AS (SELECT * FROM responses)\nSELECT {select} FROM base {tail}"


@register("b3_responses", _resp_sql("response_id, page_id, md5(body) AS body_md5, CAST(length(body) AS INTEGER) AS body_len"))
def q_b3(spark, sf_dir):
    r = load_responses(spark, sf_dir)
    return r.select("response_id", "page_id", F.md5("body").alias("body_md5"), F.length("body").alias("body_len"))


_CLEAN = q.php_trim(q.rrep("body", RS.FENCE_RX, "", ci=True))
_VALID = "(json_valid({x}) AND starts_with({x}, '{{'))"


@register("s4_repair_truncated_json", _resp_sql(
    f"response_id, {FS.repair_sql('clean')} AS repaired",
    tail=f"WHERE NOT {_VALID.format(x='clean')}").replace(
    "base AS (SELECT * FROM responses)", f"base AS (SELECT *, {_CLEAN} AS clean FROM responses)"))
def q_s4(spark, sf_dir):
    # the filter stays above the answers: pushed below, every use of the text would build the answer again
    r = once(load_responses(spark, sf_dir), "clean", RS.strip_fences("body"))
    with RS.last_key_wins(spark):
        r = r.filter(~F.coalesce(RS.is_json_object(F.col("clean")), F.lit(False)))
    return r.select("response_id", RS.repair_truncated_json("clean").alias("repaired"))


def _last(field: str) -> str:
    """The value of the last of equal keys (the JSON functions return the first)."""
    return f"(list_filter(list_zip(json_keys(j), json_extract(j, '$.*')), lambda x: x[1] = '{field}')[-1][2] ->> '$')"


def _s3_sql():
    fixed = FS.repair_sql("clean")
    status = (f"CASE WHEN {_VALID.format(x='clean')} THEN 'parsed' "
              f"WHEN {_VALID.format(x='fixed')} THEN 'repaired' ELSE 'rejected' END")
    text = (f"CASE WHEN {_VALID.format(x='clean')} THEN clean WHEN {_VALID.format(x='fixed')} THEN fixed END")
    return (f"WITH {FS.postings_raw_cte()}\n{FS.responses_cte()}\n"
            f"c AS (SELECT *, {_CLEAN} AS clean FROM responses),\n"
            f"f AS (SELECT *, CASE WHEN NOT {_VALID.format(x='clean')} THEN {fixed} END AS fixed FROM c),\n"
            f"t AS (SELECT response_id, page_id, {status} AS parse_status, {text} AS j FROM f)\n"
            f"SELECT response_id, page_id, parse_status, {_last('title')} AS title, "
            f"json_extract_string(j, '$.type') AS type, {_last('total_posts')} AS total_posts, "
            "json_extract_string(j, '$.organization') AS organization, json_extract_string(j, '$.last_date') AS last_date, "
            "CAST(json_array_length(j, '$.tags') AS INTEGER) AS n_tags, "
            "CAST(json_array_length(j, '$.important_links') AS INTEGER) AS n_links FROM t")


@register("s3_read_responses", _s3_sql())
def q_s3(spark, sf_dir):
    p = RS.read_responses(load_responses(spark, sf_dir))
    n_links = F.when(F.col("important_links").isNull(), F.lit(None)).otherwise(
        F.size(F.from_json("important_links", "array<string>")))
    return p.select("response_id", "page_id", "parse_status", "title", "type", "total_posts", "organization",
                    "last_date", F.when(F.col("tags").isNull(), F.lit(None)).otherwise(F.size("tags")).alias("n_tags"),
                    n_links.alias("n_links"))

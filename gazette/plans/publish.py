"""V3 prepare_publish: postings -> (publishable rows, rejects).

Order (decision D7 of the survey): the name -> category id lookup runs first and
transient fields are dropped last, so the correction rules see the names the
source drops too early.  Then V1, N3, L20, N2, N12, N11, E1, E4, E5 (+ id), E7,
N8, N19, L18.  All steps are per row; no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.config import DEFAULT_SITE, SiteConfig
from gazette.functions.text import empty_strs, is_blank_str, nz, strip_tags
from gazette.operators import enrich as E
from gazette.operators import normalize as N
from gazette.operators import posting_links as PL
from gazette.operators import validate as V


def prepare_publish(postings: DataFrame, site: SiteConfig = DEFAULT_SITE,
                    dim_category: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    df = E.resolve_category_id(postings, dim_category, prefer_name=False)  # E6 (name -> id when blank)
    df = V.require_fields(df)                                    # V1: plain filters on five columns
    rejects = df.filter(F.col("reject_reason").isNotNull()).select("post_id", "reject_reason")
    df = df.filter(F.col("reject_reason").isNull()).drop("reject_reason", "missing")
    df = N.null_blank_fields(df)                                 # N3
    df = df.withColumn("important_links", PL.complete_links("important_links"))   # L20
    df = N.cast_int_fields(df)                                   # N2
    df = df.withColumn("slug", F.when(is_blank_str("slug"), F.lit(None)).otherwise(F.col("slug"))) \
        if "slug" in df.columns else df.withColumn("slug", F.lit(None).cast("string"))
    df = N.derive_slug(df, site, out="_slug")                    # N12 (before the organisation is filled)
    df = df.withColumn("slug", F.coalesce(F.col("slug"), F.col("_slug"))).drop("_slug")
    df = df.withColumn("direct_apply", F.col("direct_apply").cast("boolean")) if "direct_apply" in df.columns else df
    df = N.resolve_organization(df)                              # N11
    df = df.withColumn("_src", F.concat(nz("title"), F.lit(" "), nz("short_description"), F.lit(" "),
                                        strip_tags(nz("content"))))
    df = df.withColumn("_src_l", F.lower("_src"))              # one lower-cased text for E1 and E4
    blank = (F.size(F.coalesce("education", empty_strs())) == 0) | (F.size(F.coalesce("tags", empty_strs())) == 0)
    # one scan for E1 and E4, only where one of them has something to fill in
    df = df.withColumn("_src_found", E.found_rules(F.when(blank, F.col("_src_l"))))
    h = "_src_found"
    df = E.detect_education(df, "_src", lowered="_src_l", found=h)  # E1 (only when empty)
    df = E.default_tags(df, lowered_src="_src_l", found=h)       # E4
    # E5 corrects a copy: only the category follows it, the posting's own state stays (the keywords name it)
    df = E.correct_category(df.withColumn("_state", F.col("state_name")))
    df = df.withColumn("state_name", F.col("_state")).drop("_state")
    df = E.resolve_category_id(df, dim_category)                # corrected name -> id
    df = E.override_category_by_type(df, dim_category)           # E7
    df = N.correct_salary_type(df)                               # N8
    df = N.default_keywords(df, site)                            # N19
    df = df.withColumn("important_links", PL.inject_pdf_link("important_links", "notification_pdf"))  # L18
    df = V.drop_transient_fields(df.drop("_src", "_src_l", "_src_found"))  # V2
    return df, rejects

"""Reshape / export: unpivoted display tables and JSON-LD documents.

Long tables are built with ``posexplode`` / ``unpivot`` inside each posting's
row (narrow); JSON-LD documents are ``to_json`` of nested structs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.config import DEFAULT_SITE, SiteConfig
from gazette.functions import rules
from gazette.functions.text import is_blank_str, leading_int, let, nz, php_trim, strip_tags
from gazette.sources.dims import unique_dim
from gazette.operators import links as L
from gazette.operators import normalize as N
from gazette.operators.enrich import credential_levels
from gazette.functions.text import empty_faq, empty_links, empty_strs
from gazette.operators.posting_links import pick_official_site


def _rows(df: DataFrame, keep: list[str], items: list[tuple[str, Column]], label="label", value="value",
          drop_null: bool = False) -> DataFrame:
    """(keep..., row_no, label, value) from an ordered list of (label, value expression)."""
    arr = F.array(*[F.struct(F.lit(lbl).alias(label), v.cast("string").alias(value)) for lbl, v in items])
    out = df.select(*keep, F.posexplode(arr).alias("_i", "_r")).select(
        *keep, (F.col("_i") + 1).alias("row_no"), F.col(f"_r.{label}").alias(label), F.col(f"_r.{value}").alias(value))
    return out.filter(F.col(value).isNotNull()) if drop_null else out


OPTIONAL_POSTING_FIELDS = {
    "state_name": "string", "category_name": "string", "post_name": "string", "direct_apply": "boolean",
    "qualifications": "string", "skills": "string", "responsibilities": "string", "exam_date": "string",
    "result_date": "string", "featured_image": "string", "slug": "string", "faq":
        "array<struct<question:string,answer:string>>", "important_links": "array<struct<title:string,url:string>>",
    "education": "array<string>", "start_date": "string", "notification_date": "string", "last_date": "string",
    "apply_url": "string", "online_form": "string", "salary": "string", "salary_type": "string",
}


def with_optional_fields(df: DataFrame) -> DataFrame:
    """Fields a posting may lack (dropped before publishing or never produced) as typed nulls."""
    for c, t in OPTIONAL_POSTING_FIELDS.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(t))
    return df


def _int(c) -> Column:
    return F.coalesce(leading_int(F.col(c).cast("string")), F.lit(0))


def fee_rows(df: DataFrame) -> DataFrame:
    """Four fees (OBC is not shown) as (label, amount or 'Nil / Exempted')."""
    fees = [("General / OBC", "fee_general"), ("SC / ST", "fee_sc_st"), ("PH / PWD", "fee_ph"),
            ("Female Candidates", "fee_women")]
    return _rows(df, ["post_id"], [(lbl, F.when(_int(c) > 0, F.concat(F.lit("₹"), _int(c).cast("string")))
                                   .otherwise(F.lit("Nil / Exempted"))) for lbl, c in fees])


VACANCY_COLS = [("General", "vacancy_gen"), ("OBC", "vacancy_obc"), ("SC", "vacancy_sc"), ("ST", "vacancy_st"),
                ("EWS", "vacancy_ews"), ("PH", "vacancy_ph")]


def vacancy_rows(df: DataFrame) -> DataFrame:
    """R2: six category rows + 'Total Posts' = total_posts when present (0 counts) else the sum;
    ``parts_sum`` is exposed as well."""
    parts_sum = sum((_int(c) for _, c in VACANCY_COLS), F.lit(0))
    items = [(lbl, F.coalesce(F.col(c).cast("string"), F.lit("0"))) for lbl, c in VACANCY_COLS]
    items.append(("Total Posts", F.coalesce(F.col("total_posts").cast("string"), parts_sum.cast("string"))))
    return _rows(df.withColumn("parts_sum", parts_sum.cast("long")), ["post_id", "parts_sum"], items)


def date_rows(df: DataFrame) -> DataFrame:
    """Eight labelled dates; exam/result/interview/waitlist rows are left out when unknown."""
    nd = N.NO_DATE
    wait = F.when(is_blank_str("waitlist_date"), F.lit(nd)).otherwise(N.safe_date("waitlist_date"))
    df = df.withColumn("_last", N.safe_date("last_date"))  # two rows show it
    items = [("Notification Released", N.safe_date("notification_date")),
             ("Online Apply Start", N.safe_date("start_date")),
             ("Apply Last Date", N.deadline_text_table("last_date", "deadline_time", F.col("_last"))),
             ("Fee Payment Deadline", F.col("_last")),
             ("Interview Date", N.safe_date("interview_date_from")),
             ("Exam Date", N.safe_date("exam_date")),
             ("Result Date", N.safe_date("result_date")),
             ("Waitlist Valid Until", wait)]
    skip = {"Exam Date", "Result Date", "Interview Date", "Waitlist Valid Until"}
    items = [(lbl, let(v, lambda d: F.when(d != nd, d)) if lbl in skip else v) for lbl, v in items]
    return _rows(df, ["post_id"], items, drop_null=True)


def quick_info_rows(df: DataFrame) -> DataFrame:
    """Eleven labelled values with defaults, plus a GATE note row when present."""
    df = N.age_display(df, "_age")
    edu = F.coalesce(F.col("education"), empty_strs())
    tp = F.coalesce(leading_int(F.col("total_posts").cast("string")), F.lit(0))
    items = [
        ("\U0001F3E2 Organization", F.coalesce(F.col("organization"), F.lit("Government Body"))),
        ("\U0001F4CB Post Name", F.coalesce(F.col("post_name"), F.col("title"), F.lit("Various"))),
        ("\U0001F4E2 Total Vacancies", F.when(tp > 0, F.col("total_posts").cast("string"))
         .otherwise(F.lit("As per requirement"))),
        ("\U0001F4C1 Category", F.coalesce(F.col("category_name"), F.lit("Govt Jobs"))),
        ("\U0001F4CD Location", F.coalesce(F.col("state_name"), F.lit("All India"))),
        ("\U0001F393 Education", F.when(F.size(edu) > 0, F.array_join(edu, ", ")).otherwise(F.lit(N.NO_DATE))),
        ("\U0001F382 Age Limit", F.col("_age")),
        ("\U0001F4B0 Salary", N.salary_text("salary", "salary_min")),
        ("\U0001F4B3 App Fee", F.when(_int("fee_general") > 0,
                                      F.concat(F.lit("₹"), F.col("fee_general").cast("string"),
                                               F.lit(" (Gen) | SC/ST/Women: Free"))).otherwise(F.lit("No Fee"))),
        ("\U0001F4DD Apply Mode", F.when(is_blank_str("online_form"), F.lit("Offline")).otherwise(F.lit("Online"))),
        ("\U0001F4C5 Last Date", N.deadline_text("last_date", "deadline_time")),
        ("\U0001F3AF GATE Note", F.when(~is_blank_str("gate_note"), N.html_escape("gate_note"))),
    ]
    return _rows(df, ["post_id"], items, drop_null=True)


def selection_stage_rows(df: DataFrame) -> DataFrame:
    """Stages with a 1-based number."""
    return (df.select("post_id", F.posexplode(F.coalesce("selection_stages", empty_strs())).alias("_i", "s"))
              .select("post_id", (F.col("_i") + 1).alias("stage_no"), N.html_escape(F.col("s")).alias("stage")))


def link_rows(df: DataFrame, links: str = "important_links") -> DataFrame:
    """Links with a URL, titled by the table profile, with kind, social flag and number."""
    valid = F.filter(F.coalesce(F.col(links), empty_links()), lambda x: ~is_blank_str(x["url"]))
    out = df.select("post_id", F.posexplode(valid).alias("_i", "l")).select(
        "post_id", (F.col("_i") + 1).alias("n"), F.col("l.title").alias("_raw"), F.col("l.url").alias("url"))
    out = out.withColumn("_t", php_trim(F.coalesce("_raw", F.lit("")))).withColumn("_lu", F.lower("url"))
    out = out.withColumn("title", L.title_table(F.col("_t"), F.col("_lu"), F.col("n"), F.col("_raw")))
    return out.select("post_id", "n", "title", "url", L.link_kind(F.lower("title")).alias("kind"),
                      (F.col("_lu").contains("t.me/") | F.col("_lu").contains("whatsapp.com/channel")).alias("social"))


def faq_rows(df: DataFrame) -> DataFrame:
    """(q_no, question, answer, for_export, for_display): export needs both sides non-blank
    (tags stripped, entities decoded), display needs a question."""
    out = df.select("post_id", F.posexplode(F.coalesce("faq", empty_faq())).alias("_i", "f"))
    q, a = php_trim(nz("f.question")), php_trim(nz("f.answer"))
    return out.select("post_id", (F.col("_i") + 1).alias("q_no"),
                      N.plain_text(q).alias("question"), N.plain_text(a).alias("answer"),
                      ((q != "") & (a != "")).alias("for_export"),
                      (~is_blank_str("f.question")).alias("for_display"))


def faq_jsonld(faq) -> Column:
    """FAQPage document (null when no item has both sides)."""
    items = F.filter(F.coalesce(F.col(faq), empty_faq()),
                     lambda x: (php_trim(nz(x["question"])) != "") & (php_trim(nz(x["answer"])) != ""))
    ents = F.transform(items, lambda x: F.struct(
        F.lit("Question").alias("@type"), N.plain_text(php_trim(x["question"])).alias("name"),
        F.struct(F.lit("Answer").alias("@type"), N.plain_text(php_trim(x["answer"])).alias("text"))
        .alias("acceptedAnswer")))
    doc = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("FAQPage").alias("@type"),
                   ents.alias("mainEntity"))
    return F.when(F.size(items) > 0, F.to_json(doc))


def breadcrumb_jsonld(df: DataFrame, site: SiteConfig = DEFAULT_SITE) -> Column:
    """Three-level BreadcrumbList."""
    name = F.col("category_name") if "category_name" in df.columns else F.lit(None).cast("string")
    cat = F.coalesce(name, F.lit("Jobs"))
    cat_slug = F.lower(F.replace(F.coalesce(name, F.lit("jobs")), F.lit(" "), F.lit("-")))
    job_url = N.derive_url("slug", "type", site)

    def item(pos, name, url):
        return F.struct(F.lit("ListItem").alias("@type"), F.lit(pos).alias("position"), name.alias("name"),
                        url.alias("item"))
    doc = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("BreadcrumbList").alias("@type"),
                   F.array(item(1, F.lit("Home"), F.lit(site.url)),
                           item(2, cat, F.concat(F.lit(site.url + "/category/"), cat_slug)),
                           item(3, F.coalesce(F.col("title"), F.lit("Job Post")), job_url)).alias("itemListElement"))
    return F.to_json(doc)


def posting_jsonld(df: DataFrame, site: SiteConfig = DEFAULT_SITE, links: str = "important_links",
                   out: str = "posting_jsonld") -> DataFrame:
    """The JobPosting document (organisation, location, salary, education, dates, contact).
    ``educationRequirements`` is one object for one level and a list for several, as in the source."""
    added = [c for c in OPTIONAL_POSTING_FIELDS if c not in df.columns]
    df = N.description_text(with_optional_fields(df), "_desc")
    lo, hi = N.salary_range("salary_min", "salary_max", "salary")
    df = df.withColumn("_lo", lo).withColumn("_hi", hi)
    loc_type, region = N.location_kind("state_name")
    df = (df.withColumn("_loc", loc_type).withColumn("_region", region)
            .withColumn("_site", pick_official_site(links)).withColumn("_cred", credential_levels("education"))
            .withColumn("_quals", strip_tags(nz("qualifications"))))
    org = F.struct(F.lit("Organization").alias("@type"),
                   F.when(is_blank_str("organization"), F.lit(site.name)).otherwise(F.col("organization")).alias("name"),
                   F.coalesce(F.col("_site"), F.lit(site.url)).alias("sameAs"),
                   F.coalesce(F.col("_site"), F.lit(site.url)).alias("url"),
                   F.struct(F.lit("ImageObject").alias("@type"), F.lit(site.url + "/images/logo.png").alias("url"))
                   .alias("logo"))
    place = F.struct(F.lit("Place").alias("@type"), F.struct(
        F.lit("PostalAddress").alias("@type"), F.col("_region").alias("streetAddress"),
        F.col("_region").alias("addressLocality"), F.col("_region").alias("addressRegion"),
        F.lit("000000").alias("postalCode"), F.lit("IN").alias("addressCountry")).alias("address"))
    remote = F.col("_loc") == "TELECOMMUTE"
    salary = F.struct(F.lit("MonetaryAmount").alias("@type"), F.lit("INR").alias("currency"), F.struct(
        F.lit("QuantitativeValue").alias("@type"), F.col("_lo").alias("minValue"),
        F.when(F.col("_hi") > 0, F.col("_hi")).otherwise(F.greatest(F.col("_lo"), F.lit(0))).alias("maxValue"),
        F.lit("MONTH").alias("unitText")).alias("value"))
    cred = F.transform("_cred", lambda lv: F.struct(
        F.lit("EducationalOccupationalCredential").alias("@type"), lv.alias("credentialCategory"),
        F.when(F.col("_quals") != "", F.col("_quals")).otherwise(lv).alias("description")))
    valid_through = F.concat(F.when(~is_blank_str("last_date"), F.col("last_date"))
                             .otherwise(F.date_format(F.date_add(F.lit(site.as_of).cast("date"), 90), "yyyy-MM-dd")),
                             F.lit("T23:59:59+05:30"))
    apply_link = F.coalesce(F.col("apply_url"), F.col("online_form"), F.lit(""))
    head = [
        F.lit("https://schema.org/").alias("@context"), F.lit("JobPosting").alias("@type"),
        F.coalesce(F.col("title"), F.lit("")).alias("title"), F.col("_desc").alias("description"),
        N.derive_url("slug", "type", site).alias("url"),
        F.when(~is_blank_str("notification_date"), F.col("notification_date")).otherwise(F.lit(site.as_of))
        .alias("datePosted"),
        N.employment_type("title", "salary_type", "type").alias("employmentType"),
        N.direct_apply_flag(F.col("direct_apply") if "direct_apply" in df.columns else F.lit(None),
                            "apply_url", "online_form").alias("directApply"),
        org.alias("hiringOrganization"),
        F.when(remote, F.lit("TELECOMMUTE")).alias("jobLocationType"),
        F.when(remote, F.struct(F.lit("Country").alias("@type"), F.lit("India").alias("name")))
        .alias("applicantLocationRequirements"),
        F.when(~remote, place).alias("jobLocation"),
        valid_through.alias("validThrough"),
        F.when(~is_blank_str("start_date"), F.col("start_date")).alias("jobStartDate"),
        salary.alias("baseSalary"),
        F.when(~is_blank_str(F.col("total_posts").cast("string")), _int("total_posts")).alias("totalJobOpenings"),
        F.when(~is_blank_str(apply_link), F.struct(F.lit("ContactPoint").alias("@type"),
                                                   F.lit("Apply Online").alias("contactType"),
                                                   apply_link.alias("url"))).alias("applicationContact"),
        F.when(~is_blank_str("qualifications"), F.col("_quals")).alias("qualifications"),
    ]
    tail = [
        F.when(~is_blank_str("skills"), F.col("skills")).alias("skills"),
        F.when(~is_blank_str("responsibilities"), F.col("responsibilities")).alias("responsibilities"),
        F.struct(F.lit("PropertyValue").alias("@type"), F.lit(site.name).alias("name"),
                 F.col("post_id").cast("string").alias("value")).alias("identifier"),
    ]
    opts = {"ignoreNullFields": "true"}
    one = F.to_json(F.struct(*head, F.get(cred, 0).alias("educationRequirements"), *tail), opts)
    many = F.to_json(F.struct(*head, cred.alias("educationRequirements"), *tail), opts)
    none = F.to_json(F.struct(*head, *tail), opts)
    doc = F.when(F.size("_cred") == 1, one).when(F.size("_cred") > 1, many).otherwise(none)
    return df.withColumn(out, doc).drop("_desc", "_lo", "_hi", "_loc", "_region", "_site", "_cred", "_quals", *added)


def social_meta_rows(df: DataFrame, site: SiteConfig = DEFAULT_SITE, image: str = "featured_image") -> DataFrame:
    """The 14 (name, content) social meta pairs, with the default image."""
    t, d = N.html_escape(nz("title")), N.html_escape(nz("short_description"))
    u = N.html_escape(N.derive_url("slug", "type", site))
    img = N.html_escape(F.when(is_blank_str(image), F.lit(site.image_fallback)).otherwise(F.col(image)))
    items = [("og:type", F.lit("website")), ("og:site_name", N.html_escape(F.lit(site.name))), ("og:title", t),
             ("og:description", d), ("og:url", u), ("og:image", img), ("og:locale", F.lit("en_IN")),
             ("twitter:card", F.lit("summary_large_image")), ("twitter:title", t), ("twitter:description", d),
             ("twitter:image", img), ("hreflang:en-IN", u), ("hreflang:hi", u), ("canonical", u)]
    return _rows(df, ["post_id"], items, label="name", value="content")


def card_rows(df: DataFrame, dim_card: DataFrame | None = None) -> DataFrame:
    """Ordered (label, value) card lines for the posting's type (unknown -> job); the type is
    lower-cased and its first blank becomes '_'.

    The layouts are the fixed ones, or with ``dim_card`` (type, ordinal, label, source_field, default) the rows of that table: a
    type that it lacks takes its 'job' layout, a field that postings lack is null (or the default)."""
    typ = F.regexp_replace(F.lower(F.coalesce(F.col("type"), F.lit("job"))), "^([^ ]*) ", "$1_")
    df = (df.withColumn("education_label", N.education_label("education"))
            .withColumn("age_label", N.age_label_short("age_min", "age_max_gen")))
    if dim_card is not None:
        return _card_rows_of(df.withColumn("_ctype", typ), dim_card)
    known = [t for t, _ in rules.CARD_LAYOUTS]
    df = df.withColumn("_ctype", F.when(typ.isin(*known), typ).otherwise(F.lit("job")))
    parts = []
    for t, layout in rules.CARD_LAYOUTS:
        items = []
        for label, field, default in layout:
            v = F.col(field).cast("string")
            v = v if default is None else F.when(is_blank_str(v), F.lit(default)).otherwise(v)
            items.append(F.struct(F.lit(label).alias("label"), v.alias("value")))
        parts.append((t, F.array(*items)))
    arr = None
    for t, a in parts:
        arr = F.when(F.col("_ctype") == t, a) if arr is None else arr.when(F.col("_ctype") == t, a)
    return (df.select("post_id", F.col("_ctype").alias("card_type"), F.posexplode(arr).alias("_i", "r"))
              .select("post_id", "card_type", (F.col("_i") + 1).alias("row_no"), "r.label", "r.value"))


def _card_rows_of(df: DataFrame, dim_card: DataFrame) -> DataFrame:
    """A layout (one type's lines) is one row of the grouped table; postings join it by type and keep their own lines."""
    line = F.struct(F.col("ordinal").cast("long").alias("ordinal"), "label", "source_field", F.col("default").cast("string").alias("default"))
    layouts = dim_card.filter("type is not null").groupBy(F.lower("type").alias("_type")).agg(F.array_sort(F.collect_list(line)).alias("_layout"))
    fallback = layouts.filter("_type = 'job'").select(F.lit(True).alias("_one"), F.col("_layout").alias("_job"))
    atomic = [f.name for f in df.schema if f.dataType.simpleString().split("<")[0] not in ("array", "map", "struct", "variant") and not f.name.startswith("_")]
    values = F.create_map(*[x for c in atomic for x in (F.lit(c), F.col(c).cast("string"))])
    df = df.withColumn("_values", values).join(layouts, F.col("_ctype") == F.col("_type"), "left")
    df = df.withColumn("_one", F.col("_layout").isNull()).join(fallback, "_one", "left")
    lines = F.transform(F.coalesce("_layout", "_job"), lambda x: F.struct(x["label"].alias("label"), F.when(
        x["default"].isNotNull() & is_blank_str(F.element_at("_values", x["source_field"])), x["default"]).otherwise(
        F.element_at("_values", x["source_field"])).alias("value")))
    card = F.when(F.col("_layout").isNull(), F.lit("job")).otherwise(F.col("_ctype"))
    return (df.select("post_id", card.alias("card_type"), F.posexplode(lines).alias("_i", "r"))
              .select("post_id", "card_type", (F.col("_i") + 1).alias("row_no"), "r.label", "r.value"))


def posting_summary(df: DataFrame, dim_categories: DataFrame, dim_states: DataFrame) -> DataFrame:
    """The result panel: id, vacancies (en-IN grouping), type in title case, last date,
    category / state names looked up by id (the first row of an id by ordinal)."""
    def by_id(dim, key, name):
        return unique_dim(dim.select("ordinal", F.col("id").cast("string").alias(key), F.col("name").alias(name)),
                          key, "ordinal").drop("ordinal")

    cats, sts = by_id(dim_categories, "_cid", "category"), by_id(dim_states, "_sid", "state")
    tp = F.coalesce(leading_int(F.col("total_posts").cast("string")), F.lit(0))
    typ = N.ucwords(F.replace(F.coalesce(F.col("type"), F.lit("")), F.lit("_"), F.lit(" ")))
    out = (df.withColumn("_cid", F.col("category_id").cast("string"))
             .withColumn("_sid", F.col("state_id").cast("string"))
             .join(cats, "_cid", "left").join(sts, "_sid", "left"))
    dash = F.lit("—")
    return out.select(
        "post_id",
        F.when(tp > 0, N.indian_grouping(tp)).otherwise(dash).alias("vacancies"),
        F.when(F.coalesce(F.col("type"), F.lit("")) == "", dash).otherwise(typ).alias("type_label"),
        F.when(is_blank_str("last_date"), dash).otherwise(F.col("last_date")).alias("last_date"),
        F.coalesce(F.col("category"), dash).alias("category"),
        F.coalesce(F.col("state"), F.lit("All India")).alias("state"),
        F.when(is_blank_str("salary"), dash).otherwise(F.col("salary")).alias("salary"))


def client_jsonld(df: DataFrame, site: SiteConfig = DEFAULT_SITE, state_name: str = "state_name") -> Column:
    """The minimal JobPosting the form builds when the server document is absent."""
    job_url = N.derive_url("slug", "type", site)
    doc = F.struct(
        F.lit("https://schema.org/").alias("@context"), F.lit("JobPosting").alias("@type"),
        F.coalesce(F.col("title"), F.lit("")).alias("title"),
        F.coalesce(F.col("short_description"), F.lit("")).alias("description"),
        F.when(is_blank_str("notification_date"), F.lit(site.as_of)).otherwise(F.col("notification_date"))
        .alias("datePosted"),
        F.lit(site.as_of + "T00:00:00.000Z").alias("dateModified"),
        F.lit("FULL_TIME").alias("employmentType"),
        (~is_blank_str("online_form")).alias("directApply"),
        F.struct(F.lit("Organization").alias("@type"),
                 F.when(is_blank_str("organization"), F.lit("Government of India")).otherwise(F.col("organization"))
                 .alias("name"), F.lit(site.url).alias("sameAs")).alias("hiringOrganization"),
        F.struct(F.lit("Place").alias("@type"), F.struct(
            F.lit("PostalAddress").alias("@type"), F.lit("IN").alias("addressCountry"),
            F.when(is_blank_str(state_name), F.lit("All India")).otherwise(F.col(state_name)).alias("addressRegion"))
            .alias("address")).alias("jobLocation"),
        job_url.alias("url"),
        F.when(~is_blank_str("last_date"), F.concat(F.col("last_date"), F.lit("T23:59:59+05:30"))).alias("validThrough"),
        F.when(~is_blank_str("salary"), F.struct(
            F.lit("MonetaryAmount").alias("@type"), F.lit("INR").alias("currency"),
            F.struct(F.lit("QuantitativeValue").alias("@type"), F.col("salary").alias("description"),
                     F.lit("YEAR").alias("unitText")).alias("value"))).alias("baseSalary"),
        F.when(_int("total_posts") != 0, _int("total_posts")).alias("totalJobOpenings"),
        F.when(~is_blank_str("online_form"), F.struct(
            F.lit("ContactPoint").alias("@type"), F.lit("Apply Online").alias("contactType"),
            F.col("online_form").alias("url"))).alias("applicationContact"))
    return F.to_json(doc, {"ignoreNullFields": "true"})

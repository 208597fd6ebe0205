"""Field normalisation: numbers, dates, money, slugs, display text.

All rules are column expressions; ``as_of`` and the site are parameters
(the source read the clock and a constant)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.config import DEFAULT_SITE, SiteConfig
from gazette.functions import rules
from gazette.functions.regex import java, literal
from gazette.functions.text import (byte_cut, col, decode_entities, is_blank_str, is_numeric,
                                    leading_int, let, nz, php_trim, strip_tags)
from gazette.functions.urls import is_apply_url_bare, is_valid_url, url_path, url_query, with_scheme
from gazette.sources.dims import unique_dim

INT_FIELDS = ["total_posts", "age_min", "age_max_gen", "age_max_obc", "age_max_sc", "age_max_ph",
              "age_max_ex_serviceman", "fee_general", "fee_obc", "fee_sc_st", "fee_women", "fee_ph",
              "salary_min", "salary_max", "vacancy_gen", "vacancy_obc", "vacancy_sc", "vacancy_st",
              "vacancy_ews", "vacancy_ph"]
OPTIONAL_FIELDS = ["state_id", "notification_date", "start_date", "end_date", "last_date", "salary",
                   "online_form", "final_result"]
NO_DATE = "Check Notification"


def as_str(c) -> Column:
    return col(c).cast("string")


# ---------------------------------------------------------------- N1 .. N3

def sanitize_total_posts(c) -> Column:
    """Numeric -> max(0, int); else the first digit run; else 0 ('1,234' -> 1, '-5 posts' -> 5)."""
    s = as_str(c)
    first_run = F.regexp_extract(s, "([0-9]+)", 1)
    return (F.when(is_numeric(s), F.greatest(F.lit(0).cast("long"), leading_int(s)))
            .when(first_run != "", first_run.try_cast("long"))
            .otherwise(F.lit(0).cast("long")))


def cast_int_fields(df: DataFrame, fields: list[str] = INT_FIELDS) -> DataFrame:
    """Present fields -> leading-integer rule ('12abc' -> 12); absent stay null."""
    for f in fields:
        if f in df.columns:
            df = df.withColumn(f, F.when(F.col(f).isNull(), F.lit(None).cast("long"))
                               .otherwise(leading_int(as_str(f))))
    return df


def null_blank_fields(df: DataFrame) -> DataFrame:
    """N3: '' -> missing for 8 optional fields; blank total_posts -> missing."""
    for f in OPTIONAL_FIELDS:
        if f in df.columns:
            df = df.withColumn(f, F.when(as_str(f) == "", F.lit(None)).otherwise(F.col(f)))
    if "total_posts" in df.columns:
        df = df.withColumn("total_posts", F.when(is_blank_str(as_str("total_posts")), F.lit(None))
                           .otherwise(F.col("total_posts")))
    return df


# ---------------------------------------------------------------- N4 .. N7

def parse_date(c) -> Column:
    """Date of a loosely spelt date (``rules.DATE_FORMS``), null when none applies.  A day past the
    month's end runs into the next month, as in the source."""
    def date(s, form):
        rx, *at = form
        parts = F.struct(*[F.regexp_extract(s, rx, i).alias(name) for i, name in zip(at, "ymd")])
        return F.when(s.rlike(rx), let(parts, lambda p: let(numbers(p), day_of)))  # each part is cut out once

    def numbers(p):
        number = F.coalesce(p["m"].try_cast("int"), ((F.instr(F.lit(rules.MONTHS), F.substring(p["m"], 1, 3)) + 2) / 3).cast("int"))
        return F.struct(p["y"].try_cast("int").alias("y"), number.alias("m"), p["d"].try_cast("int").alias("d"))

    def day_of(n):
        return F.when(n["m"].between(1, 12) & n["d"].between(1, 31), F.date_add(F.make_date(n["y"], n["m"], F.lit(1)), n["d"] - 1))

    s = F.regexp_replace(F.lower(php_trim(nz(as_str(c)))), rules.WEEKDAY_RX, "")
    return let(s, lambda s: F.when(s != "", F.coalesce(*[date(s, form) for form in rules.DATE_FORMS])))


def safe_date(c, fallback: str = NO_DATE) -> Column:
    """Unparseable or before 2000-01-01 -> fallback; else dd-MM-yyyy."""
    return let(parse_date(c), lambda d: F.when(
        d.isNull() | (d < F.lit("2000-01-01").cast("date")), F.lit(fallback)).otherwise(F.date_format(d, "dd-MM-yyyy")))


def deadline_text(last_date, deadline_time) -> Column:
    """N5 (quick-info form): last date or 'Apply Soon', plus ' by <time>'."""
    return let(F.struct(safe_date(last_date, "Apply Soon").alias("day"), col(deadline_time).alias("time")), lambda x: F.when(
        ~is_blank_str(x["time"]), F.concat(x["day"], F.lit(" by "), x["time"])).otherwise(x["day"]))


def deadline_text_table(last_date, deadline_time, day: Column | None = None) -> Column:
    """N5 (dates-table form): ' (by <time>)' only after a real date.  ``day`` is the ``safe_date`` of the last date where the caller has it."""
    return let(F.struct((safe_date(last_date) if day is None else day).alias("day"), col(deadline_time).alias("time")), lambda x: F.when(
        (x["day"] != NO_DATE) & ~is_blank_str(x["time"]),
        F.concat(x["day"], F.lit(" (by "), x["time"], F.lit(")"))).otherwise(x["day"]))


def salary_range(salary_min, salary_max, salary) -> tuple[Column, Column]:
    """(min, max); with both bounds 0, every digit run of the comma-free salary text counts."""
    mn = F.coalesce(leading_int(as_str(salary_min)), F.lit(0))
    mx = F.coalesce(leading_int(as_str(salary_max)), F.lit(0))
    nums = F.transform(F.regexp_extract_all(F.replace(nz(salary), F.lit(","), F.lit("")), F.lit("([0-9]+)"), 1),
                       lambda x: x.try_cast("long"))
    use_text = (mn == 0) & (mx == 0) & ~is_blank_str(salary) & (F.size(nums) > 0)
    lo = F.when(use_text, F.array_min(nums)).otherwise(mn)
    hi = F.when(use_text, F.array_max(nums)).otherwise(mx)
    return lo, F.greatest(hi, lo)


def thousands(c) -> Column:
    """1234567 -> '1,234,567'."""
    return F.format_number(col(c).cast("long"), 0)


def salary_text(salary, salary_min) -> Column:
    """Salary text or fallback, plus ' (₹n/month)' when the minimum is positive."""
    base = F.when(is_blank_str(salary), F.lit(NO_DATE)).otherwise(col(salary))
    mn = leading_int(as_str(salary_min))
    return F.when(~is_blank_str(as_str(salary_min)) & (mn > 0),
                  F.concat(base, F.lit(" (₹"), thousands(mn), F.lit("/month)"))).otherwise(base)


# ---------------------------------------------------------------- N8 .. N10

def correct_salary_type(df: DataFrame) -> DataFrame:
    """Stipend for stipend type/text or trainee/intern/apprentice titles; 'Stipend: ' prefix."""
    st = F.lower(F.coalesce(F.col("salary_type"), F.lit("salary")))
    is_stipend = ((st == "stipend") | F.lower(nz("salary")).contains("stipend")
                  | F.lower(nz("title")).rlike(java("trainee|intern|apprentice")))
    return (df.withColumn("_stipend", is_stipend)
              .withColumn("salary", F.when(F.col("_stipend") & ~is_blank_str("salary")
                                           & ~F.lower(nz("salary")).contains("stipend"),
                                           F.concat(F.lit("Stipend: "), F.col("salary")))
                          .otherwise(F.col("salary")))
              .withColumn("salary_type", F.when(F.col("_stipend"), F.lit("stipend")).otherwise(F.col("salary_type")))
              .drop("_stipend"))


def employment_type(title, salary_type, type_) -> Column:
    """INTERN > CONTRACTOR > PART_TIME > VOLUNTEER > TEMPORARY > FULL_TIME."""
    t = F.lower(nz(title))
    return (F.when(t.contains("apprentice") | t.contains("trainee") | (nz(salary_type) == "stipend"), F.lit("INTERN"))
            .when(t.contains("contract"), F.lit("CONTRACTOR"))
            .when(t.contains("part time") | (nz(type_) == "scholarship"), F.lit("PART_TIME"))
            .when(t.contains("volunteer"), F.lit("VOLUNTEER"))
            .when(t.contains("temporary"), F.lit("TEMPORARY"))
            .otherwise(F.lit("FULL_TIME")))


def direct_apply_flag(direct_apply, apply_url, online_form) -> Column:
    """Explicit flag, else the apply URL has a non-root path and a query."""
    cand = F.coalesce(col(apply_url), col(online_form), F.lit(""))
    path = F.regexp_replace(F.when(url_path(cand) == "", F.lit("/")).otherwise(url_path(cand)), "/+$", "")
    is_direct = ~is_blank_str(cand) & (path != "") & ~is_blank_str(url_query(cand))
    return F.coalesce(col(direct_apply).cast("boolean"), is_direct)


def normalize_form_urls(df: DataFrame) -> DataFrame:
    """online_form / apply_url: scheme added, invalid -> '', bare home page -> '';
    direct_apply = online_form not blank; apply_url falls back to online_form."""
    for f in ("online_form", "apply_url"):
        u = with_scheme(F.col(f))
        df = df.withColumn(f, F.when(is_blank_str(f), F.col(f))
                           .when(~is_valid_url(u), F.lit(""))
                           .when(is_apply_url_bare(u), F.lit(""))
                           .otherwise(u))
    return (df.withColumn("direct_apply", ~is_blank_str("online_form"))
              .withColumn("apply_url", F.when(is_blank_str("apply_url") & ~is_blank_str("online_form"),
                                              F.col("online_form")).otherwise(F.col("apply_url"))))


# ---------------------------------------------------------------- N11 .. N13

def _map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def resolve_organization(df: DataFrame, dim_org: DataFrame | None = None) -> DataFrame:
    """A blank organisation comes from the title: cut at the first recruitment-like word,
    year or dash; a known abbreviation as first token gives the full name; else the cut text
    when 3+ bytes; else a default.  The abbreviations are the fixed list, or with ``dim_org`` (abbrev, full_name) the rows
    of that table (of an abbreviation that occurs twice the smallest name counts)."""
    cut = php_trim(F.regexp_replace(nz("title"), java(rules.ORG_CUT_PATTERN, ci=True), ""))
    first = F.upper(F.regexp_replace(F.split(cut, " ").getItem(0), "[^A-Za-z]", ""))
    if dim_org is None:
        full = F.element_at(_map(rules.ORG_ABBREVIATIONS), first)
    else:
        dim = unique_dim(dim_org.select(F.upper(F.trim("abbrev")).alias("_abbrev"), F.col("full_name").alias("_full")), "_abbrev")
        df = df.withColumn("_first", F.when(is_blank_str("organization") & (first != ""), first))
        df, full = df.join(dim, F.col("_first") == F.col("_abbrev"), "left").drop("_first", "_abbrev"), F.col("_full")
    derived = (F.when((first != "") & full.isNotNull(), full)
               .when(F.octet_length(cut) >= 3, cut)
               .otherwise(F.lit(rules.ORG_DEFAULT)))
    return df.withColumn("organization", F.when(is_blank_str("organization"), derived)
                         .otherwise(F.col("organization"))).drop("_full")


def year_in(text, default_year: str) -> Column:
    y = F.regexp_extract(text, java(r"\b(20[0-9]{2})\b"), 1)
    return F.when(y != "", y).otherwise(F.lit(default_year))


def derive_slug(df: DataFrame, site: SiteConfig = DEFAULT_SITE, out: str = "slug",
                max_bytes: int | None = rules.SLUG_MAX_BYTES, unique_by: str | None = None) -> DataFrame:
    """Org (first 3 words, default 'govt') + title, fillers removed, ' recruitment <year>'
    [+ ' <n> posts'], non-alphanumerics -> '-', lower.

    A published slug has at most ``max_bytes`` bytes (None: the whole one).  Cut slugs can collide and
    give two postings one URL: with ``unique_by`` (an id column) a cut slug gets '-<id>' behind it."""
    org = F.when(is_blank_str("organization"), F.lit(rules.SLUG_ORG_DEFAULT)).otherwise(F.col("organization"))
    org = F.array_join(F.slice(F.split(org, " "), 1, 3), " ")
    post = F.coalesce(F.col("title"), F.lit("job"))
    df = df.withColumn("_year", year_in(F.concat(post, F.lit(" "), nz("short_description")), site.as_of_year))
    body = F.concat(org, F.lit(" "), post)
    for f in rules.SLUG_FILLERS:
        body = F.regexp_replace(body, java(r"\b" + literal(f) + r"\b", ci=True), "")
    vac = F.coalesce(leading_int(as_str("total_posts")), F.lit(0))
    base = F.concat(php_trim(body), F.lit(" recruitment "), F.col("_year"),
                    F.when(vac > 0, F.concat(F.lit(" "), vac.cast("string"), F.lit(" posts"))).otherwise(F.lit("")))
    slug = F.lower(F.regexp_replace(F.regexp_replace(base, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))
    if max_bytes is not None:
        def cut(s):
            short = F.regexp_replace(F.substring(s, 1, max_bytes), "-+$", "")
            tail = F.when(F.length(s) > max_bytes, F.concat(F.lit("-"), as_str(unique_by))) if unique_by else F.lit(None)
            return F.concat(short, F.coalesce(tail, F.lit("")))
        slug = let(slug, cut)
    return df.withColumn(out, slug).drop("_year")


def derive_url(slug, type_, site: SiteConfig = DEFAULT_SITE) -> Column:
    """<site>/<type>/<slug>, or the site URL when the slug is blank."""
    return F.when(is_blank_str(slug), F.lit(site.url)).otherwise(
        F.concat_ws("/", F.lit(site.url), F.coalesce(col(type_), F.lit("job")), col(slug)))


# ---------------------------------------------------------------- N14 .. N16

def age_display(df: DataFrame, out: str = "age_display") -> DataFrame:
    """N14: 'min – max Yrs (Gen) | OBC: .. | SC/ST: .. | PwD: .. | As on: ..' or fallback."""
    gen, mn = leading_int(as_str("age_max_gen")), leading_int(as_str("age_min"))
    head = F.concat(F.when(mn > 0, F.concat(mn.cast("string"), F.lit(" – "))).otherwise(F.lit("")),
                    gen.cast("string"), F.lit(" Yrs (Gen)"))
    asof = parse_date("age_as_on_date")
    parts = F.concat_ws(" | ",
                        F.when(leading_int(as_str("age_max_obc")) > 0,
                               F.concat(F.lit("OBC: "), as_str("age_max_obc"), F.lit(" Yrs"))),
                        F.when(leading_int(as_str("age_max_sc")) > 0,
                               F.concat(F.lit("SC/ST: "), as_str("age_max_sc"), F.lit(" Yrs"))),
                        F.when(leading_int(as_str("age_max_ph")) > 0,
                               F.concat(F.lit("PwD: "), as_str("age_max_ph"), F.lit(" Yrs"))),
                        F.when(~is_blank_str("age_as_on_date") & asof.isNotNull(),
                               F.concat(F.lit("As on: "), F.date_format(asof, "dd-MM-yyyy"))))
    full = F.when(parts != "", F.concat(head, F.lit(" | "), parts)).otherwise(head)
    return df.withColumn(out, F.when(gen > 0, full).otherwise(F.lit(NO_DATE)))


def age_label_short(age_min, age_max_gen) -> Column:
    """N14 card form: 'min – max Years' ('?' for no max), '-' when no minimum."""
    mn, mx = leading_int(as_str(age_min)), leading_int(as_str(age_max_gen))
    return F.when(mn == 0, F.lit("-")).otherwise(
        F.concat(mn.cast("string"), F.lit(" – "),
                 F.when(mx == 0, F.lit("?")).otherwise(mx.cast("string")), F.lit(" Years")))


def education_label(education) -> Column:
    """First three codes as short labels joined ', '; 'Various' when none."""
    m = _map(rules.EDUCATION_SHORT_LABELS)
    labels = F.transform(F.slice(F.coalesce(col(education), F.array().cast("array<string>")), 1, 3),
                         lambda e: F.coalesce(F.element_at(m, e), e))
    return F.when(F.size(labels) == 0, F.lit("Various")).otherwise(F.array_join(labels, ", "))


def location_kind(state_name) -> tuple[Column, Column]:
    """('TELECOMMUTE', 'India') for blank / All India, else ('PLACE', region)."""
    region = F.when(is_blank_str(state_name), F.lit(rules.ALL_INDIA)).otherwise(php_trim(col(state_name)))
    remote = (region == "") | (region == rules.ALL_INDIA)
    return (F.when(remote, F.lit("TELECOMMUTE")).otherwise(F.lit("PLACE")),
            F.when(remote, F.lit("India")).otherwise(region))


# ---------------------------------------------------------------- N17 .. N21

def ucwords(c) -> Column:
    return F.array_join(F.transform(F.split(col(c), " "),
                                    lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))),
                        " ")


def build_meta(df: DataFrame, site: SiteConfig = DEFAULT_SITE, title_bytes: int | None = 80,
               description_bytes: int | None = 160) -> DataFrame:
    """N17 + N18: meta title and meta description.  What a search engine shows has so many bytes, a
    longer one ends in '...'; None keeps the whole text."""
    org_abbr = F.when(is_blank_str("organization"), F.lit("Govt")).otherwise(F.split("organization", " ").getItem(0))
    post_n = F.coalesce(F.col("post_name"), F.col("title"), F.lit("Job"))
    v = F.coalesce(leading_int(as_str("total_posts")), F.lit(0))
    ld = parse_date("last_date")
    df = (df.withColumn("_post_n", post_n).withColumn("_v", v).withColumn("_ld", ld)
            .withColumn("_year", year_in(F.col("_post_n"), site.as_of_year)))
    hint = F.when(~is_blank_str("last_date") & F.col("_ld").isNotNull(),
                  F.concat(F.lit("Apply by "), F.date_format("_ld", "dd MMM"))).otherwise(F.lit("Apply Soon"))
    prefix = F.when(F.coalesce(F.col("is_date_extended").cast("boolean"), F.lit(False)),
                    F.lit("\U0001F525 Date Extended – ")).otherwise(F.lit(""))
    title = F.concat(prefix, org_abbr, F.lit(" "), F.col("_post_n"), F.lit(" Recruitment "), F.col("_year"),
                     F.when(F.col("_v") > 0, F.concat(F.lit(" – "), F.col("_v").cast("string"), F.lit(" Posts")))
                     .otherwise(F.lit("")),
                     F.lit(" | "), hint, F.lit(" | "), F.lit(site.name))
    edu = F.when(F.size(F.coalesce("education", F.array())) > 0, F.slice("education", 1, 3)).otherwise(
        F.array(F.lit("Graduate")))
    edu_list = F.array_join(F.transform(edu, lambda e: ucwords(F.replace(e, F.lit("_"), F.lit(" ")))), ", ")
    last_full = F.when(~is_blank_str("last_date") & F.col("_ld").isNotNull(),
                       F.date_format("_ld", "dd-MM-yyyy")).otherwise(F.lit("soon"))
    desc = F.concat(nz("organization"), F.lit(" has released "),
                    F.when(F.col("_v") > 0, F.col("_v").cast("string")).otherwise(F.lit("various")),
                    F.lit(" "), F.col("_post_n"), F.lit(" vacancies for "), F.col("_year"),
                    F.lit(". Eligibility: "), edu_list, F.lit(". Last date to apply: "), last_full,
                    F.lit(". Check qualification, salary, selection process and direct apply link here."))
    df = df.withColumn("meta_title", title).withColumn("meta_description", desc)
    for name, width in (("meta_title", title_bytes), ("meta_description", description_bytes)):
        if width is not None:
            df = df.withColumn(name, F.when(F.octet_length(name) > width, F.concat(byte_cut(name, width - 3), F.lit("...")))
                               .otherwise(F.col(name)))
    return df.drop("_post_n", "_v", "_ld", "_year")


def default_keywords(df: DataFrame, site: SiteConfig = DEFAULT_SITE) -> DataFrame:
    """When keywords are blank, the 13-item template (blank items dropped) joined ', '."""
    y = site.as_of_year
    org, title = nz("organization"), nz("title")
    state = F.coalesce(F.col("state_name"), F.lit("India"))
    items = F.array(org, title, F.concat(org, F.lit(f" recruitment {y}")), F.concat(title, F.lit(f" {y}")),
                    F.lit("sarkari naukri"), F.lit("govt jobs"), F.concat(state, F.lit(f" govt jobs {y}")),
                    F.lit("apply online"), F.lit("last date"), F.lit("notification"), F.lit("vacancy"),
                    F.lit("sarkari result"), F.lit("free job alert"))
    kw = F.array_join(F.filter(items, lambda s: ~is_blank_str(s)), ", ")
    return df.withColumn("meta_keywords", F.when(is_blank_str("meta_keywords"), kw).otherwise(F.col("meta_keywords")))


def description_text(df: DataFrame, out: str = "description", title_bytes: int | None = None,
                     max_bytes: int | None = None) -> DataFrame:
    """Plain summary (or the title) + vacancies / salary / last date.  ``title_bytes`` and
    ``max_bytes`` (off by default) cut the title and the result at so many bytes."""
    title = strip_tags(nz("title"))
    d0 = php_trim(strip_tags(nz("short_description")))
    d1 = F.when(is_blank_str(d0), php_trim(title if title_bytes is None else byte_cut(title, title_bytes))).otherwise(d0)
    ld = parse_date("last_date")
    extras = F.concat_ws(". ",
                         F.when(~is_blank_str(as_str("total_posts")) & (leading_int(as_str("total_posts")) > 0),
                                F.concat(F.lit("Total Vacancies: "), as_str("total_posts"))),
                         F.when(~is_blank_str("salary"), F.concat(F.lit("Salary: "), strip_tags("salary"))),
                         F.when(~is_blank_str("last_date") & ld.isNotNull(),
                                F.concat(F.lit("Last Date: "), F.date_format(ld, "dd-MM-yyyy"))))
    full = F.when(extras != "", F.concat(d1, F.lit(" "), extras, F.lit("."))).otherwise(d1)
    return df.withColumn(out, full if max_bytes is None else byte_cut(full, max_bytes))


def indian_grouping(n) -> Column:
    """12345678 -> '1,23,45,678' (en-IN digit grouping)."""
    s = col(n).cast("long").cast("string")
    ln = F.length(s)
    head = F.substring(s, 1, F.greatest(ln - 3, F.lit(0)))
    grouped = F.reverse(F.regexp_replace(F.regexp_replace(F.reverse(head), "([0-9]{2})", "$1,"), ",$", ""))
    return F.when(ln <= 3, s).otherwise(F.concat(grouped, F.lit(","), F.substring(s, -3, 3)))


def announcement_text(df: DataFrame, site: SiteConfig = DEFAULT_SITE) -> DataFrame:
    """The two announcement texts -> long (post_id, channel, text)."""
    job_url = derive_url("slug", "type", site)
    channel = F.concat(
        F.lit(f"\U0001F6A8 *New Recruitment {site.as_of_year}* \U0001F6A8\n\n"),
        F.lit("\U0001F3E2 *Org:* "), F.coalesce(F.col("organization"), F.lit("Govt Job")), F.lit("\n"),
        F.lit("\U0001F4CC *Post:* "), F.coalesce(F.col("title"), F.lit("New Job Alert")), F.lit("\n"),
        F.lit("\U0001F4BC *Vacancies:* "), F.coalesce(as_str("total_posts"), F.lit("Various")), F.lit("\n"),
        F.lit("\U0001F4C5 *Last Date:* "), F.coalesce(F.col("last_date"), F.lit("Check website")), F.lit("\n\n"),
        F.lit("\U0001F449 *Details & Apply:* "), job_url)
    tp = leading_int(as_str("total_posts"))
    share = F.concat_ws("\n",
                        F.concat(F.lit("\U0001F514 *"), F.when(is_blank_str("title"), F.lit("New Govt Job"))
                                 .otherwise(F.col("title")), F.lit("*")),
                        F.when(~is_blank_str("organization"), F.concat(F.lit("\U0001F3DB️ "), F.col("organization")))
                        .otherwise(F.lit("")),
                        F.when(~is_blank_str(as_str("total_posts")) & (tp != 0),
                               F.concat(F.lit("\U0001F4CB Vacancies: "), indian_grouping(tp))).otherwise(F.lit("")),
                        F.when(~is_blank_str("salary"), F.concat(F.lit("\U0001F4B0 Salary: "), F.col("salary")))
                        .otherwise(F.lit("")),
                        F.when(~is_blank_str("last_date"), F.concat(F.lit("⏰ Last Date: "), F.col("last_date")))
                        .otherwise(F.lit("")),
                        F.lit(""), F.lit("✅ Apply Now:"), job_url, F.lit(""),
                        F.lit(f"\U0001F4F2 More Govt Jobs: {site.url}"))
    return df.select("post_id", F.explode(F.array(
        F.struct(F.lit("channel").alias("channel"), channel.alias("text")),
        F.struct(F.lit("share").alias("channel"), share.alias("text")))).alias("m")).select(
        "post_id", "m.channel", "m.text")


def html_escape(c) -> Column:
    """htmlspecialchars (ENT_QUOTES)."""
    out = F.replace(col(c), F.lit("&"), F.lit("&amp;"))
    for a, b in [('"', "&quot;"), ("'", "&#039;"), ("<", "&lt;"), (">", "&gt;")]:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def plain_text(c) -> Column:
    """strip_tags + entity decode (for JSON-LD text)."""
    return decode_entities(strip_tags(col(c)))

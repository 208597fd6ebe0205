"""Registered queries over the derived postings (B2): N*, E*, L14..L23, R*, V*."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette.config import DEFAULT_SITE
from gazette.functions import rules
from gazette.functions.text import is_blank_str, leading_int, nz, strip_tags
from gazette.operators import enrich as E
from gazette.operators import normalize as N
from gazette.operators import posting_links as PL
from gazette.operators import reshape as R
from gazette.operators import validate as V
from gazette.oracle import postings_sql as S
from gazette.oracle import sqlfn as q
from gazette.plans.fixtures import load_postings_raw
from gazette.plans.registry import register

SITE = DEFAULT_SITE
W = S.with_postings


def _p(spark, sf_dir, last="documents"):
    return load_postings_raw(spark, sf_dir, last)


def _links_text(c):
    return F.array_join(F.transform(c, lambda x: F.concat(x["title"], F.lit(" <"), x["url"], F.lit(">"))), " | ")


def _links_text_sql(e):
    return f"array_to_string(list_transform({e}, lambda x: x.title || ' <' || x.url || '>'), ' | ')"


_FAQ_MD5 = "md5(array_to_string(list_transform(faq, lambda x: x.question || chr(1) || x.answer), chr(2)))"


@register("b2_postings_raw", W(
    "post_id, type, organization, title, post_name, short_description, md5(content) AS content_md5, "
    "category_name, state_name, notification_date, start_date, last_date, interview_date_from, waitlist_date, "
    "age_as_on_date, total_posts, vacancy_gen, salary, salary_type, online_form, apply_url, notification_pdf, "
    "array_to_string(selection_stages, '|') AS stages, array_to_string(education, '|') AS education, "
    f"{_links_text_sql('important_links')} AS links, CAST(len(faq) AS BIGINT) AS n_faq, {_FAQ_MD5} AS faq_md5, "
    "meta_keywords, category_id, state_id, source_url, is_date_extended"))
def q_postings_raw(spark, sf_dir):
    p = _p(spark, sf_dir)
    faq_md5 = F.md5(F.array_join(F.transform("faq", lambda x: F.concat(x["question"], F.lit("\x01"), x["answer"])),
                                 "\x02"))
    return p.select("post_id", "type", "organization", "title", "post_name", "short_description",
                    F.md5("content").alias("content_md5"), "category_name", "state_name", "notification_date",
                    "start_date", "last_date", "interview_date_from", "waitlist_date", "age_as_on_date",
                    "total_posts", "vacancy_gen", "salary", "salary_type", "online_form", "apply_url",
                    "notification_pdf", F.array_join("selection_stages", "|").alias("stages"),
                    F.array_join("education", "|").alias("education"),
                    _links_text(F.col("important_links")).alias("links"),
                    F.size("faq").cast("long").alias("n_faq"), faq_md5.alias("faq_md5"),
                    "meta_keywords", "category_id", "state_id", "source_url", "is_date_extended")


@register("n1_sanitize_total_posts", W(f"post_id, total_posts AS raw, {S.sanitize_total_posts('total_posts')} AS total_posts"))
def q_n1(spark, sf_dir):
    p = _p(spark, sf_dir)
    return p.select("post_id", F.col("total_posts").alias("raw"), N.sanitize_total_posts("total_posts").alias("total_posts"))


def _n2_sql():
    cols = []
    for f in N.INT_FIELDS:
        src = f"(CASE WHEN {S.blank('total_posts')} THEN NULL ELSE total_posts END)" if f == "total_posts" else f
        cols.append(f"CASE WHEN {src} IS NULL THEN NULL ELSE {S.lint(src)} END AS {f}")
    for f in ["state_id", "last_date", "salary", "online_form"]:
        cols.append(f"CASE WHEN {f} = '' THEN NULL ELSE {f} END AS {f}_kept")
    return W("post_id, " + ", ".join(cols))


@register("n2_n3_cast_and_null_fields", _n2_sql())
def q_n2(spark, sf_dir):
    p = N.cast_int_fields(N.null_blank_fields(_p(spark, sf_dir)))
    return p.select("post_id", *N.INT_FIELDS, *[F.col(f).alias(f + "_kept") for f in
                                                ["state_id", "last_date", "salary", "online_form"]])


@register("n4_n5_dates", W(
    f"post_id, {S.safe_date('notification_date')} AS notification, {S.safe_date('age_as_on_date')} AS as_on, "
    f"{S.deadline_text('last_date', 'deadline_time')} AS last_date_info, "
    f"{S.deadline_text_table('last_date', 'deadline_time')} AS last_date_table"))
def q_n4(spark, sf_dir):
    p = _p(spark, sf_dir)
    return p.select("post_id", N.safe_date("notification_date").alias("notification"),
                    N.safe_date("age_as_on_date").alias("as_on"),
                    N.deadline_text("last_date", "deadline_time").alias("last_date_info"),
                    N.deadline_text_table("last_date", "deadline_time").alias("last_date_table"))


_lo, _hi = S.salary_range("salary_min", "salary_max", "salary")


@register("n6_n7_salary", W(f"post_id, CAST({_lo} AS BIGINT) AS min_value, CAST({_hi} AS BIGINT) AS max_value, "
                            f"{S.salary_text('salary', 'salary_min')} AS salary_text"))
def q_n6(spark, sf_dir):
    p = _p(spark, sf_dir)
    lo, hi = N.salary_range("salary_min", "salary_max", "salary")
    return p.select("post_id", lo.cast("long").alias("min_value"), hi.cast("long").alias("max_value"),
                    N.salary_text("salary", "salary_min").alias("salary_text"))


def _n8_sql():
    st = "lower(coalesce(salary_type, 'salary'))"
    lt = f"lower({S.nz('title')})"
    stip = f"({st} = 'stipend' OR contains(lower({S.nz('salary')}), 'stipend') OR {q.rlike(lt, 'trainee|intern|apprentice')})"
    sal = (f"CASE WHEN {stip} AND NOT {S.blank('salary')} AND NOT contains(lower({S.nz('salary')}), 'stipend') "
           f"THEN 'Stipend: ' || salary ELSE salary END")
    stype = f"CASE WHEN {stip} THEN 'stipend' ELSE salary_type END"
    return W(f"post_id, salary, salary_type, {S.employment_type('title', 'salary_type', 'type')} AS employment_type, "
             f"{S.direct_apply_flag('NULL', 'apply_url', 'online_form')} AS direct_apply",
             src=f"(SELECT * REPLACE ({sal} AS salary, {stype} AS salary_type) FROM postings_raw)")


@register("n8_n9_n10_salary_type_employment", _n8_sql())
def q_n8(spark, sf_dir):
    p = N.correct_salary_type(_p(spark, sf_dir))
    return p.select("post_id", "salary", "salary_type",
                    N.employment_type("title", "salary_type", "type").alias("employment_type"),
                    N.direct_apply_flag(F.lit(None), "apply_url", "online_form").alias("direct_apply"))


def _l23_sql():
    inner = f"(SELECT * REPLACE ({S.norm_form_url('online_form')} AS online_form, {S.norm_form_url('apply_url')} AS apply_url) FROM postings_raw)"
    return W(f"post_id, online_form, CASE WHEN {S.blank('apply_url')} AND NOT {S.blank('online_form')} THEN online_form "
             f"ELSE apply_url END AS apply_url, NOT {S.blank('online_form')} AS direct_apply", src=inner)


@register("l23_normalize_form_urls", _l23_sql())
def q_l23(spark, sf_dir):
    return N.normalize_form_urls(_p(spark, sf_dir)).select("post_id", "online_form", "apply_url", "direct_apply")


@register("n11_resolve_organization", W(f"post_id, {S.resolve_organization('organization', 'title')} AS organization"))
def q_n11(spark, sf_dir):
    return N.resolve_organization(_p(spark, sf_dir)).select("post_id", "organization")


@register("n11_live_organizations", f"""WITH {S.postings_raw_cte()}
dim AS (SELECT upper(trim(string_split(p_name, ' ')[1])) AS abbrev, min(p_name || ' Board') AS full_name FROM part GROUP BY 1),
t AS (SELECT post_id, organization, {S.organization_cut('title')} AS cut FROM postings_raw),
f AS (SELECT *, upper(regexp_replace(string_split(cut, ' ')[1], '[^A-Za-z]', '', 'g')) AS first FROM t)
SELECT post_id, CASE WHEN NOT {S.blank('organization')} THEN organization WHEN first <> '' AND full_name IS NOT NULL THEN full_name
                     WHEN strlen(cut) >= 3 THEN cut ELSE {S.s(rules.ORG_DEFAULT)} END AS organization
FROM f LEFT JOIN dim ON first = abbrev""")
def q_n11_live(spark, sf_dir):
    """N11 with a table of abbreviations: the first word of each part name, which titles start with."""
    from gazette.session import read_table
    dim = read_table(spark, sf_dir, "part").select(F.split("p_name", " ").getItem(0).alias("abbrev"), F.concat("p_name", F.lit(" Board")).alias("full_name"))
    return N.resolve_organization(_p(spark, sf_dir), dim).select("post_id", "organization")


_SLUG_SQL = S.derive_slug("organization", "title", "short_description", "total_posts")


@register("n12_n13_slug_url", W(f"post_id, slug, {S.derive_url('slug', 'type')} AS url",
                                src=f"(SELECT *, {_SLUG_SQL} AS slug FROM postings_raw)"))
def q_n12(spark, sf_dir):
    p = N.derive_slug(_p(spark, sf_dir))
    return p.select("post_id", "slug", N.derive_url("slug", "type").alias("url"))


_LT, _REG = S.location_kind("state_name")


@register("n14_n15_n16_display", W(
    f"post_id, {S.age_display()} AS age_display, {S.age_label_short('age_min', 'age_max_gen')} AS age_label, "
    f"{S.education_label('education')} AS education_label, {_LT} AS location_type, {_REG} AS region"))
def q_n14(spark, sf_dir):
    p = N.age_display(_p(spark, sf_dir))
    lt, reg = N.location_kind("state_name")
    return p.select("post_id", "age_display", N.age_label_short("age_min", "age_max_gen").alias("age_label"),
                    N.education_label("education").alias("education_label"), lt.alias("location_type"),
                    reg.alias("region"))


def _meta_parts():
    """Uncut meta title and description (N17, N18) over the columns of a posting."""
    org_abbr = f"(CASE WHEN {S.blank('organization')} THEN 'Govt' ELSE string_split(organization, ' ')[1] END)"
    post_n = "coalesce(post_name, title, 'Job')"
    v = f"coalesce({S.lint('total_posts')}, 0)"
    ld = S.parse_date("last_date")
    year = S.year_in(post_n, SITE.as_of_year)
    hint = (f"(CASE WHEN NOT {S.blank('last_date')} AND {ld} IS NOT NULL THEN 'Apply by ' || strftime({ld}, '%d %b') "
            f"ELSE 'Apply Soon' END)")
    prefix = "(CASE WHEN coalesce(is_date_extended, false) THEN '\U0001F525 Date Extended – ' ELSE '' END)"
    title = (f"{prefix} || {org_abbr} || ' ' || {post_n} || ' Recruitment ' || {year} || "
             f"(CASE WHEN {v} > 0 THEN ' – ' || CAST({v} AS VARCHAR) || ' Posts' ELSE '' END) || ' | ' || {hint} || "
             f"' | ' || {S.s(SITE.name)}")
    edu = "(CASE WHEN len(coalesce(education, [])) > 0 THEN list_slice(education, 1, 3) ELSE ['Graduate'] END)"
    spaced = "replace(e, '_', ' ')"
    edu_list = f"array_to_string(list_transform({edu}, lambda e: {S.ucwords(spaced)}), ', ')"
    last_full = (f"(CASE WHEN NOT {S.blank('last_date')} AND {ld} IS NOT NULL THEN strftime({ld}, '%d-%m-%Y') "
                 f"ELSE 'soon' END)")
    desc = (f"{S.nz('organization')} || ' has released ' || (CASE WHEN {v} > 0 THEN CAST({v} AS VARCHAR) ELSE 'various' END)"
            f" || ' ' || {post_n} || ' vacancies for ' || {year} || '. Eligibility: ' || {edu_list} || "
            f"'. Last date to apply: ' || {last_full} || '. Check qualification, salary, selection process and direct apply link here.'")
    return title, desc


_META_TITLE = f"(CASE WHEN strlen(t) > 80 THEN {q.byte_cut('t', 77)} || '...' ELSE t END)"
_META_DESCRIPTION = f"(CASE WHEN strlen(d) > 160 THEN {q.byte_cut('d', 157)} || '...' ELSE d END)"


def _meta_sql():
    title, desc = _meta_parts()
    return W(f"post_id, {_META_TITLE} AS meta_title, {_META_DESCRIPTION} AS meta_description",
             src=f"(SELECT post_id, {title} AS t, {desc} AS d FROM postings_raw)")


@register("n17_n18_meta", _meta_sql())
def q_n17(spark, sf_dir):
    return N.build_meta(_p(spark, sf_dir)).select("post_id", "meta_title", "meta_description")


def _kw_sql():
    y = SITE.as_of_year
    org, title = S.nz("organization"), S.nz("title")
    state = "coalesce(state_name, 'India')"
    items = (f"[{org}, {title}, {org} || ' recruitment {y}', {title} || ' {y}', 'sarkari naukri', 'govt jobs', "
             f"{state} || ' govt jobs {y}', 'apply online', 'last date', 'notification', 'vacancy', "
             f"'sarkari result', 'free job alert']")
    kw = f"array_to_string(list_filter({items}, lambda x: NOT {S.blank('x')}), ', ')"
    return W(f"post_id, CASE WHEN {S.blank('meta_keywords')} THEN {kw} ELSE meta_keywords END AS meta_keywords")


@register("n19_default_keywords", _kw_sql())
def q_n19(spark, sf_dir):
    return N.default_keywords(_p(spark, sf_dir)).select("post_id", "meta_keywords")


def _desc_expr():
    d0 = q.php_trim(q.strip_tags(S.nz("short_description")))
    d1 = f"(CASE WHEN {S.blank(d0)} THEN {q.php_trim(q.strip_tags(S.nz('title')))} ELSE {d0} END)"
    ld = S.parse_date("last_date")
    extras = (f"concat_ws('. ', CASE WHEN NOT {S.blank('total_posts')} AND {S.lint('total_posts')} > 0 THEN "
              f"'Total Vacancies: ' || total_posts END, CASE WHEN NOT {S.blank('salary')} THEN 'Salary: ' || "
              f"{q.strip_tags('salary')} END, CASE WHEN NOT {S.blank('last_date')} AND {ld} IS NOT NULL THEN "
              f"'Last Date: ' || strftime({ld}, '%d-%m-%Y') END)")
    full = f"(CASE WHEN {extras} <> '' THEN {d1} || ' ' || {extras} || '.' ELSE {d1} END)"
    return full


def _desc_sql():
    return W(f"post_id, {_desc_expr()} AS description")


@register("n20_description_text", _desc_sql())
def q_n20(spark, sf_dir):
    return N.description_text(_p(spark, sf_dir)).select("post_id", "description")


def _announce_sql():
    url = S.derive_url("slug", "type")
    y = SITE.as_of_year
    channel = (f"'\U0001F6A8 *New Recruitment {y}* \U0001F6A8' || chr(10) || chr(10) || '\U0001F3E2 *Org:* ' || "
               f"coalesce(organization, 'Govt Job') || chr(10) || '\U0001F4CC *Post:* ' || coalesce(title, 'New Job Alert') "
               f"|| chr(10) || '\U0001F4BC *Vacancies:* ' || coalesce(total_posts, 'Various') || chr(10) || "
               f"'\U0001F4C5 *Last Date:* ' || coalesce(last_date, 'Check website') || chr(10) || chr(10) || "
               f"'\U0001F449 *Details & Apply:* ' || {url}")
    tp = S.lint("total_posts")
    share = (f"concat_ws(chr(10), '\U0001F514 *' || (CASE WHEN {S.blank('title')} THEN 'New Govt Job' ELSE title END) || '*', "
             f"CASE WHEN NOT {S.blank('organization')} THEN '\U0001F3DB️ ' || organization ELSE '' END, "
             f"CASE WHEN NOT {S.blank('total_posts')} AND {tp} <> 0 THEN '\U0001F4CB Vacancies: ' || {S.indian_grouping(tp)} ELSE '' END, "
             f"CASE WHEN NOT {S.blank('salary')} THEN '\U0001F4B0 Salary: ' || salary ELSE '' END, "
             f"CASE WHEN NOT {S.blank('last_date')} THEN '⏰ Last Date: ' || last_date ELSE '' END, "
             f"'', '✅ Apply Now:', {url}, '', '\U0001F4F2 More Govt Jobs: {SITE.url}')")
    return (f"WITH {S.postings_raw_cte()}\nbase AS (SELECT *, {_SLUG_SQL} AS slug FROM postings_raw)\n"
            f"SELECT post_id, 'channel' AS channel, {channel} AS text FROM base UNION ALL "
            f"SELECT post_id, 'share' AS channel, {share} AS text FROM base")


@register("n21_announcement_text", _announce_sql())
def q_n21(spark, sf_dir):
    return N.announcement_text(N.derive_slug(_p(spark, sf_dir)))


# ---------------------------------------------------------------- enrichment

_DETECT_SRC = "content || ' ' || qualifications || ' ' || short_description"


def _detect_src():
    return F.concat_ws(" ", nz("content"), nz("qualifications"), nz("short_description"))


@register("e1_detect_education", W(f"post_id, array_to_string({S.detect_education('src', 'education')}, '|') AS education",
                                   src=f"(SELECT *, {_DETECT_SRC} AS src FROM postings_raw)"))
def q_e1(spark, sf_dir):
    p = _p(spark, sf_dir).withColumn("src", _detect_src())
    return E.detect_education(p, "src").select("post_id", F.array_join("education", "|").alias("education"))


@register("e2_detect_tags", W(f"post_id, array_to_string({S.detect_tags('src', 'tags')}, '|') AS tags",
                              src=f"(SELECT *, {_DETECT_SRC} AS src FROM postings_raw)"))
def q_e2(spark, sf_dir):
    p = _p(spark, sf_dir).withColumn("src", _detect_src())
    return E.detect_tags(p, "src").select("post_id", F.array_join("tags", "|").alias("tags"))


_SIG_TAGS, _SIG_EXT = S.update_signals("src")


@register("e3_update_signals", W(f"post_id, array_to_string({_SIG_TAGS}, '|') AS tags, {_SIG_EXT} AS is_date_extended",
                                 src=f"(SELECT *, {_DETECT_SRC} AS src FROM postings_raw)"))
def q_e3(spark, sf_dir):
    p = _p(spark, sf_dir).withColumn("src", _detect_src())
    p = E.apply_update_signals(p, "src")
    return p.select("post_id", F.array_join("tags", "|").alias("tags"), "is_date_extended")


@register("e4_default_tags", W(f"post_id, array_to_string({S.default_tags()}, '|') AS tags"))
def q_e4(spark, sf_dir):
    return E.default_tags(_p(spark, sf_dir)).select("post_id", F.array_join("tags", "|").alias("tags"))


_CAT, _ST = S.correct_category()


@register("e5_correct_category", W(f"post_id, {_CAT} AS category_name, {_ST} AS state_name"))
def q_e5(spark, sf_dir):
    return E.correct_category(_p(spark, sf_dir)).select("post_id", "category_name", "state_name")


def _e6_sql():
    tmap = "MAP {" + ", ".join(f"{S.s(k)}: {S.s(v)}" for k, v in rules.TYPE_CATEGORY) + "}"
    forced = f"{tmap}[coalesce(type, 'job')]"
    inner = f"(SELECT * REPLACE ({_CAT} AS category_name, {_ST} AS state_name) FROM postings_raw)"
    return W(f"post_id, coalesce({forced}, category_name) AS category_name, "
             f"{S.category_id('category_id', 'category_name')} AS category_id, "
             f"CASE WHEN {forced} IS NOT NULL THEN 'category not in dimension: ' || {forced} END AS category_warning",
             src=inner)


@register("e6_e7_category_id", _e6_sql())
def q_e6(spark, sf_dir):
    from gazette.sources.dims import dim_category
    p = E.correct_category(_p(spark, sf_dir))
    p = E.resolve_category_id(p, dim_category(spark))
    p = E.override_category_by_type(p)
    return p.select("post_id", "category_name", "category_id", "category_warning")


def _e8_sql(name_col, entries, prefix):
    cands = "[" + ", ".join(f"{{'ordinal': {i + 1}, 'id': {S.s(str(id_))}, 'lname': {S.s(nm.lower().strip())}}}"
                            for i, (id_, nm) in enumerate(entries)) + "]"
    qv = f"lower(trim({S.nz(name_col)}))"
    exact = f"list_filter({cands}, lambda c: c.lname = qq)[1]"
    score = ("greatest(CASE WHEN contains(qq, c.lname) THEN length(c.lname) ELSE 0 END, "
             "CASE WHEN contains(c.lname, qq) THEN length(qq) ELSE 0 END, "
             "CASE WHEN len(list_filter(qw, lambda w: list_contains(regexp_split_to_array(c.lname, '\\s+'), w))) > 0 "
             "THEN 5 * len(list_filter(qw, lambda w: list_contains(regexp_split_to_array(c.lname, '\\s+'), w))) ELSE 0 END)")
    scored = f"list_filter(list_transform({cands}, lambda c: {{'score': {score}, 'neg_ord': -c.ordinal, 'id': c.id}}), lambda x: x.score > 0)"
    best = f"list_sort({scored}, 'DESC')[1]"
    return W(f"post_id, {name_col} AS name, coalesce(ex.id, bs.id) AS {prefix}_id, "
             f"CASE WHEN ex.id IS NOT NULL THEN 'exact' WHEN bs.id IS NOT NULL THEN 'fuzzy' END AS {prefix}_match, "
             f"CASE WHEN ex.id IS NOT NULL THEN NULL ELSE bs.score END AS {prefix}_score",
             src=f"(SELECT post_id, {name_col}, CASE WHEN qq = '' THEN NULL ELSE {exact} END AS ex, "
                 f"CASE WHEN qq = '' THEN NULL ELSE {best} END AS bs FROM (SELECT *, {qv} AS qq, "
                 f"regexp_split_to_array({qv}, '\\s+') AS qw FROM postings_raw))")


@register("e8_match_state", _e8_sql("state_name", rules.FALLBACK_STATES, "state"))
def q_e8s(spark, sf_dir):
    from gazette.operators.name_match import match_dim_table
    from gazette.sources.dims import dim_state
    p = match_dim_table(_p(spark, sf_dir), "state_name", dim_state(spark), "state")
    return p.select("post_id", F.col("state_name").alias("name"), "state_id", "state_match",
                    F.col("state_score").cast("long").alias("state_score"))


@register("e8_match_category", _e8_sql("category_name", rules.FALLBACK_CATEGORIES, "category"))
def q_e8c(spark, sf_dir):
    p = E.match_dim_by_name(_p(spark, sf_dir), "category_name", rules.FALLBACK_CATEGORIES, "category")
    return p.select("post_id", F.col("category_name").alias("name"), "category_id", "category_match",
                    F.col("category_score").cast("long").alias("category_score"))


@register("e9_credential_levels", W(f"post_id, array_to_string({S.credential_levels('education')}, '|') AS levels",
                                    src=f"(SELECT * REPLACE ({S.detect_education(_DETECT_SRC, 'education')} AS education) FROM postings_raw)"))
def q_e9(spark, sf_dir):
    p = E.detect_education(_p(spark, sf_dir).withColumn("src", _detect_src()), "src")
    return p.select("post_id", F.array_join(E.credential_levels("education"), "|").alias("levels"))


def _e10_sql():
    from gazette.functions.regex import literal
    rx = r"""<a[^>]+href=["']https?://(?:www\.)?""" + literal(SITE.host) + r"""(?:[/?#][^"']*)?["']"""
    n = f"CAST(len(regexp_extract_all({S.nz('content')}, {q.rx(rx, ci=True)}, 0)) AS BIGINT)"
    return W(f"post_id, {n} AS n_site_links, {n} >= 5 AS meets_target")


@register("e10_required_link_target", _e10_sql())
def q_e10(spark, sf_dir):
    n, ok = E.required_link_target("content", SITE)
    return _p(spark, sf_dir).select("post_id", n.cast("long").alias("n_site_links"), ok.alias("meets_target"))


def _e11_sql():
    typ = "coalesce(type, 'job')"
    exam = "('admit_card', 'result', 'answer_key', 'syllabus')"
    checks = []
    for f in E.ZERO_NUMBERS:
        applies = f"({typ} IN {exam} OR {typ} = 'blog'" + (f" OR {typ} = 'scholarship')" if f == "total_posts" else ")")
        checks.append(f"CASE WHEN {applies} AND {S.lint(f)} <> 0 THEN '{f}' END")
    checks.append(f"CASE WHEN ({typ} IN {exam} OR {typ} = 'blog') AND len(coalesce(education, [])) > 0 THEN 'education' END")
    for f in ("qualifications", "skills", "responsibilities"):
        checks.append(f"CASE WHEN {typ} IN {exam} AND NOT {S.blank(f)} THEN '{f}' END")
    return W(f"post_id, array_to_string(list_filter([{', '.join(checks)}], lambda x: x IS NOT NULL), ',') AS violations")


@register("e11_type_zero_fields", _e11_sql())
def q_e11(spark, sf_dir):
    p = _p(spark, sf_dir)
    return p.select("post_id", F.array_join(E.type_zero_fields(p), ",").alias("violations"))


# ---------------------------------------------------------------- reshape

def _rows_sql(items, keep="post_id", label="label", value="value", drop_null=False, src="postings_raw",
              extra_keep=""):
    arr = "[" + ", ".join(f"{{'l': {S.s(lbl)}, 'v': CAST({v} AS VARCHAR)}}" for lbl, v in items) + "]"
    where = "WHERE r.v IS NOT NULL" if drop_null else ""
    return (f"WITH {S.postings_raw_cte()}\nbase AS (SELECT *, {arr} AS arr FROM {src})\n"
            f"SELECT {keep}{extra_keep}, CAST(row_no AS INTEGER) AS row_no, r.l AS {label}, r.v AS {value} FROM "
            f"(SELECT {keep}{extra_keep}, unnest(range(1, len(arr) + 1)) AS row_no, unnest(arr) AS r FROM base) {where}")


def _int_sql(c):
    return f"coalesce({S.lint(c)}, 0)"


@register("r1_fee_rows", _rows_sql([(lbl, f"CASE WHEN {_int_sql(c)} > 0 THEN '₹' || CAST({_int_sql(c)} AS VARCHAR) "
                                          f"ELSE 'Nil / Exempted' END")
                                    for lbl, c in [("General / OBC", "fee_general"), ("SC / ST", "fee_sc_st"),
                                                   ("PH / PWD", "fee_ph"), ("Female Candidates", "fee_women")]]))
def q_r1(spark, sf_dir):
    return R.fee_rows(_p(spark, sf_dir)).withColumn("row_no", F.col("row_no").cast("int"))


def _r2_sql():
    parts = " + ".join(_int_sql(c) for _, c in R.VACANCY_COLS)
    items = [(lbl, f"coalesce({c}, '0')") for lbl, c in R.VACANCY_COLS]
    items.append(("Total Posts", f"coalesce(CAST(total_posts AS VARCHAR), CAST({parts} AS VARCHAR))"))
    return _rows_sql(items, extra_keep=", parts_sum", src=f"(SELECT *, CAST({parts} AS BIGINT) AS parts_sum FROM postings_raw)")


@register("r2_vacancy_rows", _r2_sql())
def q_r2(spark, sf_dir):
    return R.vacancy_rows(_p(spark, sf_dir)).withColumn("row_no", F.col("row_no").cast("int"))


def _r3_sql():
    nd = S.NO_DATE
    wait = f"(CASE WHEN {S.blank('waitlist_date')} THEN '{nd}' ELSE {S.safe_date('waitlist_date')} END)"
    items = [("Notification Released", S.safe_date("notification_date")),
             ("Online Apply Start", S.safe_date("start_date")),
             ("Apply Last Date", S.deadline_text_table("last_date", "deadline_time")),
             ("Fee Payment Deadline", S.safe_date("last_date")),
             ("Interview Date", S.safe_date("interview_date_from")),
             ("Exam Date", S.safe_date("exam_date")), ("Result Date", S.safe_date("result_date")),
             ("Waitlist Valid Until", wait)]
    skip = {"Exam Date", "Result Date", "Interview Date", "Waitlist Valid Until"}
    items = [(lbl, f"(CASE WHEN {v} = '{nd}' THEN NULL ELSE {v} END)" if lbl in skip else v) for lbl, v in items]
    return _rows_sql(items, drop_null=True)


@register("r3_date_rows", _r3_sql())
def q_r3(spark, sf_dir):
    return R.date_rows(_p(spark, sf_dir)).withColumn("row_no", F.col("row_no").cast("int"))


def _r4_sql():
    tp = _int_sql("total_posts")
    items = [
        ("\U0001F3E2 Organization", "coalesce(organization, 'Government Body')"),
        ("\U0001F4CB Post Name", "coalesce(post_name, title, 'Various')"),
        ("\U0001F4E2 Total Vacancies", f"CASE WHEN {tp} > 0 THEN total_posts ELSE 'As per requirement' END"),
        ("\U0001F4C1 Category", "coalesce(category_name, 'Govt Jobs')"),
        ("\U0001F4CD Location", "coalesce(state_name, 'All India')"),
        ("\U0001F393 Education", f"CASE WHEN len(coalesce(education, [])) > 0 THEN array_to_string(education, ', ') "
                                 f"ELSE '{S.NO_DATE}' END"),
        ("\U0001F382 Age Limit", S.age_display()),
        ("\U0001F4B0 Salary", S.salary_text("salary", "salary_min")),
        ("\U0001F4B3 App Fee", f"CASE WHEN {_int_sql('fee_general')} > 0 THEN '₹' || fee_general || "
                               f"' (Gen) | SC/ST/Women: Free' ELSE 'No Fee' END"),
        ("\U0001F4DD Apply Mode", f"CASE WHEN {S.blank('online_form')} THEN 'Offline' ELSE 'Online' END"),
        ("\U0001F4C5 Last Date", S.deadline_text("last_date", "deadline_time")),
        ("\U0001F3AF GATE Note", f"CASE WHEN NOT {S.blank('gate_note')} THEN {S.html_escape('gate_note')} END"),
    ]
    return _rows_sql(items, drop_null=True)


@register("r4_quick_info_rows", _r4_sql())
def q_r4(spark, sf_dir):
    return R.quick_info_rows(_p(spark, sf_dir)).withColumn("row_no", F.col("row_no").cast("int"))


@register("r5_selection_stage_rows", f"""WITH {S.postings_raw_cte()}
x AS (SELECT post_id, unnest(range(1, len(selection_stages) + 1)) AS stage_no, unnest(selection_stages) AS s
      FROM postings_raw)
SELECT post_id, CAST(stage_no AS INTEGER) AS stage_no, {S.html_escape('s')} AS stage FROM x""")
def q_r5(spark, sf_dir):
    return R.selection_stage_rows(_p(spark, sf_dir)).withColumn("stage_no", F.col("stage_no").cast("int"))


def _r6_sql():
    from gazette.oracle.pages_sql import link_kind_sql, title_table_sql
    t = title_table_sql("raw", "url", "n")
    return f"""WITH {S.postings_raw_cte()}
v AS (SELECT post_id, list_filter(important_links, lambda x: NOT {S.blank('x.url')}) AS l FROM postings_raw),
x AS (SELECT post_id, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS lk FROM v),
y AS (SELECT post_id, n, lk.title AS raw, lk.url AS url FROM x)
SELECT post_id, CAST(n AS INTEGER) AS n, {t} AS title, url, {link_kind_sql(t)} AS kind,
       (contains(lower(url), 't.me/') OR contains(lower(url), 'whatsapp.com/channel')) AS social FROM y"""


@register("r6_link_rows", _r6_sql())
def q_r6(spark, sf_dir):
    return R.link_rows(_p(spark, sf_dir)).withColumn("n", F.col("n").cast("int"))


def _r7_sql():
    qq, aa = q.php_trim(S.nz("f.question")), q.php_trim(S.nz("f.answer"))
    return f"""WITH {S.postings_raw_cte()}
x AS (SELECT post_id, unnest(range(1, len(faq) + 1)) AS q_no, unnest(faq) AS f FROM postings_raw)
SELECT post_id, CAST(q_no AS INTEGER) AS q_no, {q.decode_entities(q.strip_tags(qq))} AS question,
       {q.decode_entities(q.strip_tags(aa))} AS answer, ({qq} <> '' AND {aa} <> '') AS for_export,
       NOT {S.blank('f.question')} AS for_display FROM x"""


@register("r7_faq_rows", _r7_sql())
def q_r7(spark, sf_dir):
    return R.faq_rows(_p(spark, sf_dir, "conversations")).withColumn("q_no", F.col("q_no").cast("int"))


def _r11_sql():
    slug_src = f"(SELECT *, {_SLUG_SQL} AS slug FROM postings_raw)"
    t, d = S.html_escape(S.nz("title")), S.html_escape(S.nz("short_description"))
    u = S.html_escape(S.derive_url("slug", "type"))
    img = S.html_escape(f"CASE WHEN {S.blank('featured_image')} THEN '{SITE.image_fallback}' ELSE featured_image END")
    items = [("og:type", "'website'"), ("og:site_name", S.html_escape(S.s(SITE.name))), ("og:title", t),
             ("og:description", d), ("og:url", u), ("og:image", img), ("og:locale", "'en_IN'"),
             ("twitter:card", "'summary_large_image'"), ("twitter:title", t), ("twitter:description", d),
             ("twitter:image", img), ("hreflang:en-IN", u), ("hreflang:hi", u), ("canonical", u)]
    return _rows_sql(items, label="name", value="content", src=slug_src)


@register("r11_social_meta_rows", _r11_sql())
def q_r11(spark, sf_dir):
    return R.social_meta_rows(N.derive_slug(_p(spark, sf_dir))).withColumn("row_no", F.col("row_no").cast("int"))


_CARD_TYPE = "(CASE {n} % 4 WHEN 0 THEN 'job' WHEN 1 THEN 'result' WHEN 2 THEN 'syllabus' ELSE 'blog' END)"
_CARD_VALUE = "(CASE WHEN ordinal % 2 = 1 THEN state_name ELSE salary END)"


def _r12_sql():
    typ = f"regexp_replace(lower(coalesce(type, 'job')), '^([^ ]*) ', {S.s(chr(92) + '1_')})"
    known = "[" + ", ".join(S.s(t) for t, _ in rules.CARD_LAYOUTS) + "]"
    ctype = f"(CASE WHEN list_contains({known}, {typ}) THEN {typ} ELSE 'job' END)"
    fields = {"education_label": S.education_label("education"),
              "age_label": S.age_label_short("age_min", "age_max_gen")}
    cases = []
    for t, layout in rules.CARD_LAYOUTS:
        items = []
        for label, field, default in layout:
            v = fields.get(field, f"CAST({field} AS VARCHAR)")
            if default is not None:
                v = f"(CASE WHEN {S.blank(v)} THEN {S.s(default)} ELSE {v} END)"
            items.append(f"{{'label': {S.s(label)}, 'value': {v}}}")
        cases.append(f"WHEN ctype = {S.s(t)} THEN [{', '.join(items)}]")
    arr = "CASE " + " ".join(cases) + " END"
    return f"""WITH {S.postings_raw_cte()}
b AS (SELECT *, {ctype} AS ctype FROM postings_raw),
c AS (SELECT post_id, ctype, {arr} AS arr FROM b),
x AS (SELECT post_id, ctype, unnest(range(1, len(arr) + 1)) AS row_no, unnest(arr) AS r FROM c)
SELECT post_id, ctype AS card_type, CAST(row_no AS INTEGER) AS row_no, r.label AS label, r.value AS value FROM x"""


@register("r12_card_rows", _r12_sql())
def q_r12(spark, sf_dir):
    return R.card_rows(_p(spark, sf_dir)).withColumn("row_no", F.col("row_no").cast("int"))


@register("r12_live_cards", f"""WITH {S.postings_raw_cte()}
layout AS (SELECT {_CARD_TYPE.format(n='l_orderkey')} AS type, l_linenumber AS ordinal, min(l_returnflag) AS label, min(l_linestatus) AS fallback
           FROM lineitem GROUP BY ALL),
lines AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY ordinal) AS row_no FROM layout),
p AS (SELECT *, coalesce(type, 'job') AS want FROM postings_raw),
c AS (SELECT p.*, CASE WHEN EXISTS (SELECT 1 FROM layout l WHERE l.type = want) THEN want ELSE 'job' END AS card_type FROM p)
SELECT post_id, card_type, CAST(row_no AS INTEGER) AS row_no, label, CASE WHEN {S.blank(_CARD_VALUE)} THEN fallback ELSE {_CARD_VALUE} END AS value
FROM c JOIN lines ON lines.type = c.card_type""")
def q_r12_live(spark, sf_dir):
    """R12 with a table of layouts made of order lines: type by order key, line number, flag as label, status as default."""
    from gazette.session import read_table
    mod = F.col("l_orderkey") % 4
    dim = read_table(spark, sf_dir, "lineitem").groupBy(
        F.when(mod == 0, "job").when(mod == 1, "result").when(mod == 2, "syllabus").otherwise("blog").alias("type"), F.col("l_linenumber").alias("ordinal")
    ).agg(F.min("l_returnflag").alias("label"), F.min("l_linestatus").alias("default"))
    odd = F.col("ordinal") % 2
    dim = dim.withColumn("source_field", F.when(odd == 1, "state_name").otherwise("salary"))
    return R.card_rows(_p(spark, sf_dir), dim).withColumn("row_no", F.col("row_no").cast("int"))


# ---------------------------------------------------------------- posting links

@register("l18_l20_l21_pdf_complete_official", W(
    f"post_id, {_links_text_sql('l18')} AS with_pdf, {_links_text_sql('l20')} AS complete, "
    f"l21 AS official_site",
    src=f"""(SELECT post_id,
    CASE WHEN NOT {S.blank('notification_pdf')} AND {q.is_valid_url('notification_pdf')}
          AND len(list_filter(important_links, lambda x: NOT {S.blank('x.url')} AND lower(x.url) = lower(notification_pdf))) = 0
         THEN list_prepend({{'title': 'Official Notification PDF', 'url': notification_pdf}}, important_links)
         ELSE important_links END AS l18,
    list_filter(important_links, lambda x: NOT {S.blank('x.title')} AND NOT {S.blank('x.url')}) AS l20,
    list_filter(important_links, lambda x: NOT {S.blank('x.url')} AND
                {q.rlike(S.nz('x.title'), 'official.?website|official.?site', ci=True)})[1].url AS l21
  FROM postings_raw)"""))
def q_l18(spark, sf_dir):
    p = _p(spark, sf_dir)
    return p.select("post_id", _links_text(PL.inject_pdf_link("important_links", "notification_pdf")).alias("with_pdf"),
                    _links_text(PL.complete_links("important_links")).alias("complete"),
                    PL.pick_official_site("important_links").alias("official_site"))


def _hosted(col_sql=False):
    # the hosted copy of a notification PDF: <site>/pdfs/<md5 of its url>.pdf (null without a valid url)
    if col_sql:
        return (f"CASE WHEN {q.is_valid_url('notification_pdf')} THEN '{SITE.url}/pdfs/' || md5(notification_pdf) "
                f"|| '.pdf' END")
    from gazette.functions.urls import is_valid_url
    return F.when(is_valid_url("notification_pdf"),
                  F.concat(F.lit(SITE.url + "/pdfs/"), F.md5("notification_pdf"), F.lit(".pdf")))


def _l19_sql():
    hit = (f"list_transform(important_links, lambda x: {q.rlike(S.nz('x.url'), chr(92) + '.pdf', ci=True)} OR "
           f"{q.rlike(S.nz('x.title'), 'notification|advt', ci=True)})")
    new = "{'title': 'Official Notification PDF', 'url': h}"
    return W(f"post_id, {_links_text_sql('res')} AS links", src=f"""(SELECT post_id,
      CASE WHEN h IS NULL THEN important_links
           WHEN idx > 0 THEN list_transform(important_links, lambda x, i: CASE WHEN i = idx THEN {new} ELSE x END)
           ELSE list_prepend({new}, important_links) END AS res
    FROM (SELECT *, {_hosted(True)} AS h, coalesce(list_position({hit}, true), 0) AS idx FROM postings_raw))""")


@register("l19_replace_pdf_link", _l19_sql())
def q_l19(spark, sf_dir):
    p = _p(spark, sf_dir)
    return p.select("post_id", _links_text(PL.replace_pdf_link("important_links", _hosted())).alias("links"))


@register("l22_related_links", f"""WITH {S.postings_raw_cte()}
dim AS (SELECT * FROM (VALUES {", ".join(f"({S.s(t)}, {i + 1}, {S.s(SITE.url + pth)}, {S.s(lbl)})"
                                          for t, items in rules.RELATED_LINKS for i, (pth, lbl) in enumerate(items))})
        AS d(type, ordinal, url, label))
SELECT p.post_id, d.ordinal, d.url, d.label
FROM postings_raw p JOIN dim d ON d.type = CASE WHEN p.type IN
  ({", ".join(S.s(t) for t, _ in rules.RELATED_LINKS if t != "default")}) THEN p.type ELSE 'default' END""")
def q_l22(spark, sf_dir):
    return PL.related_links(_p(spark, sf_dir), PL.dim_related(spark))


# ---------------------------------------------------------------- validation

def _v1_sql():
    reason = "CASE " + " ".join(f"WHEN {S.blank(f)} THEN 'Required field missing: {f}'" for f in V.REQUIRED_FIELDS) + " END"
    missing = ("array_to_string(list_filter([" + ", ".join(f"CASE WHEN {S.blank(f)} THEN {S.s(lbl)} END" for f, lbl in
                                                        zip(V.REQUIRED_FIELDS, V.REQUIRED_LABELS)) +
               "], lambda x: x IS NOT NULL), ', ')")
    return W(f"post_id, {reason} AS reject_reason, {missing} AS missing")


@register("v1_require_fields", _v1_sql())
def q_v1(spark, sf_dir):
    p = V.require_fields(_p(spark, sf_dir))
    return p.select("post_id", "reject_reason", F.array_join("missing", ", ").alias("missing"))


@register("v5_length_audit", W(", ".join(
    [f"CAST(count(*) FILTER (WHERE length(coalesce({c}, '')) > {lim}) AS BIGINT) AS n_{c}_over"
     for c, lim in V.LENGTH_LIMITS] + ["CAST(count(*) AS BIGINT) AS n_postings"])))
def q_v5(spark, sf_dir):
    return V.length_audit_summary(V.length_audit(_p(spark, sf_dir)))


@register("v6_v7_keyword_faq_counts", W(
    "post_id, CAST(len(list_filter(list_transform(string_split(coalesce(meta_keywords, ''), ','), "
    f"lambda x: {q.php_trim('x')}), lambda x: x <> '' AND x <> '0')) AS BIGINT) AS kw_count, "
    "CAST(len(faq) AS BIGINT) AS faq_count, "
    f"CAST(len(regexp_extract_all(coalesce(content, ''), {q.rx(chr(34) + '@type' + chr(34) + r'[ \t\n\r\f]*:[ \t\n\r\f]*' + chr(34) + 'Question' + chr(34))})) AS BIGINT) AS content_questions"))
def q_v6(spark, sf_dir):
    p = V.faq_count(_p(spark, sf_dir), keep=[V.keyword_count("meta_keywords").cast("long").alias("kw_count")])
    return p.select("post_id", "kw_count", "faq_count", "content_questions")


@register("v9_vocab_audit", f"""WITH {S.postings_raw_cte()}
t AS (SELECT post_id, 'tag' AS kind, unnest(tags) AS code FROM postings_raw),
e AS (SELECT post_id, 'education' AS kind, unnest(education) AS code FROM postings_raw)
SELECT post_id, kind, code FROM t WHERE code NOT IN ({", ".join(S.s(v) for v in rules.VOCAB_TAGS)})
UNION ALL
SELECT post_id, kind, code FROM e WHERE code NOT IN ({", ".join(S.s(v) for v in rules.VOCAB_EDUCATION)})""")
def q_v9(spark, sf_dir):
    from gazette.sources.dims import vocab
    return V.vocab_audit(_p(spark, sf_dir), vocab(spark, "tag"), vocab(spark, "education"))


# ---------------------------------------------------------------- content

def _p7_sql():
    parts = "string_split(coalesce(content, ''), '<h3')"
    link_rx = q.rx(r"^<h3[^>]*>\s*important\s+links.*?</h3>", ci=True, dotall=True)
    faq_rx = q.rx(r"^<h3[^>]*>\s*frequently\s+asked.*?</h3>", ci=True, dotall=True)
    kept = (f"list_filter(list_transform({parts}, lambda p, i: CASE WHEN i = 1 THEN p ELSE '<h3' || p END), "
            f"lambda p, i: i = 1 OR NOT (regexp_matches(p, {link_rx}) OR regexp_matches(p, {faq_rx})))")
    joined = f"array_to_string({kept}, '')"
    return W(f"post_id, {q.rrep(joined, r'<script\b[^>]*>.*?</script>', '', ci=True, dotall=True)} AS content")


@register("p7_strip_sections", _p7_sql())
def q_p7(spark, sf_dir):
    from gazette.operators.pages import strip_sections
    return _p(spark, sf_dir).select("post_id", strip_sections("content").alias("content"))


def _p8_sql():
    from gazette.operators.pages import HEADER_BLOCKS, STAY_UPDATED_MARKER
    has_sel = "len(coalesce(selection_stages, [])) > 0"
    has_faq = f"len(list_filter(coalesce(faq, []), lambda x: NOT {S.blank('x.question')})) > 0"
    has_links = f"len(list_filter(coalesce(important_links, []), lambda x: NOT {S.blank('x.url')})) > 0"
    body = q.rrep("coalesce(content, '')", "[ \t\n\r\x00\x0b]+$", "")
    head = ", ".join(f"{{'kind': '{k}', 'chars': NULL::INTEGER, 'keep': {has_sel if k == 'selection' else 'true'}}}"
                     for k in HEADER_BLOCKS)
    faq_b = f"{{'kind': 'faq', 'chars': NULL::INTEGER, 'keep': {has_faq}}}"
    links_b = f"{{'kind': 'links', 'chars': NULL::INTEGER, 'keep': {has_links}}}"
    tail = (f"CASE WHEN len(parts) > 1 THEN flatten(list_transform(parts[2:], lambda p: [{faq_b}, {links_b}, "
            f"{{'kind': 'stay_updated', 'chars': CAST(length({S.s(STAY_UPDATED_MARKER)} || p) AS INTEGER), 'keep': true}}]))"
            f" ELSE [{faq_b}, {links_b}] END")
    blocks = (f"list_filter(list_concat([{head}], [{{'kind': 'content', 'chars': CAST(length(parts[1]) AS INTEGER), "
              f"'keep': true}}], {tail}), lambda b: b.keep)")
    return f"""WITH {S.postings_raw_cte()}
a AS (SELECT *, string_split({body}, {S.s(STAY_UPDATED_MARKER)}) AS parts FROM postings_raw),
b AS (SELECT post_id, {blocks} AS blocks FROM a),
x AS (SELECT post_id, unnest(range(1, len(blocks) + 1)) AS block_no, unnest(blocks) AS bk FROM b)
SELECT post_id, CAST(block_no AS INTEGER) AS block_no, bk.kind AS kind, bk.chars AS chars FROM x"""


@register("p8_assemble_content", _p8_sql())
def q_p8(spark, sf_dir):
    from gazette.operators.pages import assemble_content
    return assemble_content(_p(spark, sf_dir)).withColumn("block_no", F.col("block_no").cast("int"))


# ---------------------------------------------------------------- L14 .. L17 (response links + page links)

def _l14_src():
    # the model's link list as JSON text; every third posting sends it as an object keyed by position
    return F.when(F.col("post_id") % 3 == 0, F.to_json(F.map_from_arrays(
        F.transform(F.col("important_links"), lambda x, i: (i + 1).cast("string")),
        F.transform(F.col("important_links"), lambda x: F.create_map(
            F.lit("name"), x["title"], F.lit("href"), x["url"]))))).otherwise(F.to_json("important_links"))


def _l14_sql():
    from gazette.oracle.pages_sql import title_client_sql
    t = title_client_sql("t", "u", "n")
    return f"""WITH {S.postings_raw_cte()}
x AS (SELECT post_id, unnest(range(1, len(important_links) + 1)) AS n, unnest(important_links) AS lk FROM postings_raw),
y AS (SELECT post_id, n, coalesce(lk.title, '') AS t, coalesce(lk.url, '') AS u FROM x),
z AS (SELECT post_id, n, {t} AS title, u AS url FROM y),
k AS (SELECT * FROM z WHERE title <> '' OR url <> '')
SELECT p.post_id, coalesce(string_agg(k.title || ' <' || k.url || '>', ' | ' ORDER BY k.n), '') AS links
FROM postings_raw p LEFT JOIN k USING (post_id) GROUP BY p.post_id"""


@register("l14_coerce_link_objects", _l14_sql())
def q_l14(spark, sf_dir):
    p = _p(spark, sf_dir).withColumn("raw", _l14_src())
    return p.select("post_id", _links_text(PL.coerce_link_objects(F.col("raw"))).alias("links"))


def _official_ctes():
    """ok (accepted page URLs of pages_ext) and official (page_id, pos, url, title)."""
    from gazette.oracle.pages_sql import gated_pages_sql, links_ctes, title_server_sql
    return f"""gated AS ({gated_pages_sql('pages_ext')}),
ok AS (SELECT page_id, url, html FROM gated WHERE reject_reason IS NULL),
{links_ctes('ok')},
official AS (SELECT page_id, pos, link_url AS url,
    {title_server_sql('title', 'link_url', 'row_number() OVER (PARTITION BY page_id ORDER BY pos)')} AS title
  FROM uniq_links WHERE link_class = 'official'),"""


def _merge_ctes():
    """withchan: the merged links (post_id, src, ord, title, url) of posts (post_id, page_id, source_url, important_links)
    and official (L15, L16, L17)."""
    from gazette.oracle.pages_sql import link_class_sql, title_server_sql
    cand_url = q.with_scheme("lk.url")
    n = "row_number() OVER (PARTITION BY post_id ORDER BY src, ord)"
    chan = []
    for marker, title, url in SITE.channels:
        chan.append(f"SELECT p.post_id, 9 AS src, {len(chan)} AS ord, {S.s(title)} AS title, {S.s(url)} AS url "
                    f"FROM posts p LEFT JOIN titled t USING (post_id) "
                    f"GROUP BY p.post_id HAVING count(*) FILTER (WHERE contains(t.url, {S.s(marker)})) = 0")
    source_domain = f"CASE WHEN {S.blank('source_url')} THEN '' ELSE {q.registrable_domain('source_url')} END"
    return f"""cand0 AS (SELECT post_id, source_url, unnest(range(1, len(important_links) + 1)) AS ord, unnest(important_links) AS lk FROM posts),
cand1 AS (SELECT post_id, source_url, ord, coalesce(lk.title, '') AS title, {cand_url} AS url FROM cand0 WHERE NOT {S.blank('lk.url')}),
cand AS (SELECT post_id, 1 AS src, ord, title, url FROM cand1 WHERE {q.is_valid_url('url')} AND
    {link_class_sql('url', source_domain)} <> 'aggregator'),
offi AS (SELECT p.post_id, 0 AS src, o.pos AS ord, o.title, o.url FROM posts p JOIN official o ON o.page_id = p.page_id),
allk AS (SELECT * FROM offi UNION ALL SELECT * FROM cand),
kept AS (SELECT * FROM allk QUALIFY src = 0 OR (row_number() OVER (PARTITION BY post_id, lower(url) ORDER BY src, ord) = 1
         AND NOT EXISTS (SELECT 1 FROM offi o2 WHERE o2.post_id = allk.post_id AND lower(o2.url) = lower(allk.url)))),
titled AS (SELECT post_id, src, ord, {title_server_sql('title', 'url', n)} AS title, url FROM kept),
withchan AS (SELECT * FROM titled UNION ALL {' UNION ALL '.join(chan)})"""


def _merge_sql():
    from gazette.oracle.fixtures_sql import pages_ext_cte
    return f"""WITH {pages_ext_cte()}
{_official_ctes()}
{S.postings_raw_cte()}
posts AS (SELECT post_id, source_url, important_links, post_id % (SELECT count(*) FROM pages) AS page_id FROM postings_raw),
{_merge_ctes()}
SELECT p.post_id, coalesce(string_agg(w.title || ' <' || w.url || '>', ' | ' ORDER BY w.src, w.ord), '') AS links
FROM posts p LEFT JOIN withchan w USING (post_id) GROUP BY p.post_id"""


@register("l15_l16_l17_merge_links", _merge_sql())
def q_merge(spark, sf_dir):
    from gazette.plans.fixtures import pages_ext, row_count
    from gazette.plans.scrape import official_links
    from gazette.session import read_table
    from gazette.sources.pages import gate_pages, split_rejects
    pages = read_table(spark, sf_dir, "pages")
    facts = official_links(split_rejects(gate_pages(pages_ext(pages)))[0]).select("page_id", "official_links")
    p = _p(spark, sf_dir).withColumn("page_id", F.col("post_id") % row_count(pages))
    p = p.join(facts, "page_id", "left")
    cand = PL.sanitize_candidate_links("important_links", "source_url", SITE)
    merged = PL.ensure_channel_links(PL.merge_links("official_links", cand), SITE)
    return p.select("post_id", _links_text(merged).alias("links"))


# ---------------------------------------------------------------- compositions (V3, V4)

@register("v3_prepare_publish", S.prepare_publish_sql())
def q_v3(spark, sf_dir):
    """Every published column of the accepted postings, and the rejected ones with their reason."""
    from gazette.plans.publish import prepare_publish
    from gazette.sources.dims import dim_category
    return published_rows(*prepare_publish(_p(spark, sf_dir), SITE, dim_category(spark)))


def published_rows(ok, bad):
    ok = ok.withColumn("content_md5", F.md5("content"))
    names = N.INT_FIELDS + N.OPTIONAL_FIELDS + S.PUBLISHED_TEXT
    out = ok.select("post_id", F.lit(None).cast("string").alias("reject_reason"), "slug", "organization",
                    F.col("category_id").cast("long").alias("category_id"), F.array_join("tags", "|").alias("tags"),
                    F.array_join("education", "|").alias("education"), "meta_keywords",
                    _links_text(F.col("important_links")).alias("links"), *names)
    rej = bad.select("post_id", "reject_reason", *[F.lit(None).cast(t).alias(c) for c, t in out.dtypes[2:]])
    return out.unionByName(rej)


def v4_sql():
    """V4 twin, from the source's order of steps: parse, posts, urls, category, education and tags, signals, links,
    meta, channels, sections, counts."""
    from gazette.oracle.fixtures_sql import pages_ext_cte, repair_sql, responses_cte
    from gazette.oracle.pages_sql import page_facts_sql
    from gazette.sources.responses import FENCE_RX
    valid = "(json_valid({x}) AND starts_with({x}, '{{'))".format
    clean = q.php_trim(q.rrep("body", FENCE_RX, "", ci=True))
    last = lambda f: f"(list_filter(list_zip(json_keys(j), json_extract(j, '$.*')), lambda x: x[1] = '{f}')[-1][2] ->> '$')"
    text = ["organization", "short_description", "last_date", "category_name", "state_name", "online_form", "salary"]
    fields = ", ".join(f"json_extract_string(j, '$.{f}') AS {f}" for f in text)
    cat, state = S.correct_category()
    tags, extended = S.update_signals("src")
    title, desc = _meta_parts()
    return f"""WITH {pages_ext_cte()}
facts AS ({page_facts_sql('pages_ext')}),
{_official_ctes()}
{S.postings_raw_cte()}
{responses_cte()}
c AS (SELECT *, {clean} AS clean FROM responses),
f AS (SELECT *, CASE WHEN NOT {valid(x='clean')} THEN {repair_sql('clean')} END AS fixed FROM c),
t AS (SELECT response_id, page_id, CASE WHEN {valid(x='clean')} THEN clean WHEN {valid(x='fixed')} THEN fixed END AS j FROM f),
p0 AS (SELECT response_id AS post_id, page_id, {last('title')} AS title, json_extract_string(j, '$.type') AS type0, {last('total_posts')} AS tp0, {fields},
         from_json(json_extract(j, '$.tags'), '["VARCHAR"]') AS tags, from_json(json_extract(j, '$.education'), '["VARCHAR"]') AS education,
         from_json(json_extract(j, '$.important_links'), '[{{"title":"VARCHAR","url":"VARCHAR"}}]') AS important_links,
         json_array_length(j, '$.faq') AS n_faq
       FROM t WHERE j IS NOT NULL),
p1 AS (SELECT p0.*, coalesce(type0, a.detected_type, 'job') AS type, {S.sanitize_total_posts('tp0')} AS total_posts, a.url AS source_url,
         a.text AS raw_text, a.page_id AS known_page, NULL::VARCHAR AS post_name, NULL::VARCHAR AS content, NULL::BOOLEAN AS is_date_extended
       FROM p0 LEFT JOIN facts a ON a.page_id = p0.page_id),
p2 AS (SELECT * REPLACE ({cat} AS category_name, {state} AS state_name), '  ' || coalesce(raw_text, '') AS src FROM p1),
p3 AS (SELECT * REPLACE ({S.detect_education('src', 'education')} AS education, {S.detect_tags('src', 'tags')} AS tags) FROM p2),
p4 AS (SELECT * REPLACE ({tags} AS tags, {extended} AS is_date_extended) FROM p3),
m AS (SELECT post_id, {title} AS t, {desc} AS d FROM p4),
posts AS (SELECT post_id, source_url, coalesce(important_links, []) AS important_links, known_page AS page_id FROM p4),
{_merge_ctes()},
links AS (SELECT post_id, string_agg(title || ' <' || url || '>', ' | ' ORDER BY src, ord) AS links FROM withchan GROUP BY post_id)
SELECT p4.post_id, type, title, total_posts, category_name, is_date_extended, array_to_string(tags, '|') AS tags,
       array_to_string(education, '|') AS education, {_META_TITLE} AS meta_title, {_META_DESCRIPTION} AS meta_description,
       coalesce(links, '') AS links, md5('') AS content_md5, 0::BIGINT AS kw_count, coalesce(n_faq, 0)::BIGINT AS faq_count
FROM p4 JOIN m USING (post_id) LEFT JOIN links USING (post_id)"""


@register("v4_enrich_batch", v4_sql())
def q_v4(spark, sf_dir):
    from gazette.plans.enrich import enrich_batch
    from gazette.plans.fixtures import load_responses, pages_ext
    from gazette.plans.scrape import scrape_batch
    from gazette.session import read_table
    facts, _ = scrape_batch(pages_ext(read_table(spark, sf_dir, "pages")))
    return enriched_rows(enrich_batch(load_responses(spark, sf_dir), facts, SITE)[0])


def enriched_rows(posts):
    return posts.select("post_id", "type", "title", "total_posts", "category_name", "is_date_extended",
                        F.array_join("tags", "|").alias("tags"), F.array_join("education", "|").alias("education"),
                        "meta_title", "meta_description", _links_text(F.col("important_links")).alias("links"),
                        F.md5("content").alias("content_md5"), "kw_count", "faq_count")


# ---------------------------------------------------------------- JSON-LD and summary (R8 .. R14, S7)

def _r8_sql():
    qq, aa = q.php_trim(S.nz("x.question")), q.php_trim(S.nz("x.answer"))
    items = f"list_filter(coalesce(faq, []), lambda x: {qq} <> '' AND {aa} <> '')"
    ents = (f"list_transform({items}, lambda x: {{'@type': 'Question', 'name': {q.decode_entities(q.strip_tags(qq))}, "
            f"'acceptedAnswer': {{'@type': 'Answer', 'text': {q.decode_entities(q.strip_tags(aa))}}}}})")
    doc = f"CAST(to_json({{'@context': 'https://schema.org', '@type': 'FAQPage', 'mainEntity': {ents}}}) AS VARCHAR)"
    return W(f"post_id, CASE WHEN len({items}) > 0 THEN {doc} END AS faq_jsonld")


@register("r8_faq_jsonld", _r8_sql())
def q_r8(spark, sf_dir):
    return _p(spark, sf_dir, "conversations").select("post_id", R.faq_jsonld("faq").alias("faq_jsonld"))


def _r10_sql():
    cat = "coalesce(category_name, 'Jobs')"
    cat_slug = "lower(replace(coalesce(category_name, 'jobs'), ' ', '-'))"
    url = S.derive_url("slug", "type")
    doc = (f"CAST(to_json({{'@context': 'https://schema.org', '@type': 'BreadcrumbList', 'itemListElement': ["
           f"{{'@type': 'ListItem', 'position': 1, 'name': 'Home', 'item': '{SITE.url}'}}, "
           f"{{'@type': 'ListItem', 'position': 2, 'name': {cat}, 'item': '{SITE.url}/category/' || {cat_slug}}}, "
           f"{{'@type': 'ListItem', 'position': 3, 'name': coalesce(title, 'Job Post'), 'item': {url}}}]}}) AS VARCHAR)")
    return W(f"post_id, {doc} AS breadcrumb_jsonld", src=f"(SELECT *, {_SLUG_SQL} AS slug FROM postings_raw)")


@register("r10_breadcrumb_jsonld", _r10_sql())
def q_r10(spark, sf_dir):
    p = N.derive_slug(_p(spark, sf_dir))
    return p.select("post_id", R.breadcrumb_jsonld(p, SITE).alias("breadcrumb_jsonld"))


def _jget(doc_col, paths):
    return [F.get_json_object(doc_col, f"$.{p}").alias(a) for p, a in paths]


_R9_PATHS = [("title", "title"), ("url", "url"), ("employmentType", "employment_type"),
             ("directApply", "direct_apply"), ("hiringOrganization.name", "org_name"),
             ("hiringOrganization.url", "org_url"), ("jobLocationType", "location_type"),
             ("jobLocation.address.addressRegion", "region"), ("validThrough", "valid_through"),
             ("baseSalary.value.minValue", "min_value"), ("baseSalary.value.maxValue", "max_value"),
             ("totalJobOpenings", "openings"), ("identifier.value", "identifier"), ("description", "description"),
             ("datePosted", "date_posted"), ("jobStartDate", "start"), ("hiringOrganization.logo.url", "logo"),
             ("applicationContact.url", "contact"), ("qualifications", "qualifications"), ("skills", "skills"),
             ("responsibilities", "responsibilities"), ("applicantLocationRequirements.name", "applicants"),
             ("jobLocation.address.streetAddress", "street"), ("baseSalary.value.unitText", "unit")]


def _r9_sql():
    lo, hi = S.salary_range("salary_min", "salary_max", "salary")
    lt, reg = S.location_kind("state_name")
    site_rx = q.rlike(S.nz("x.title"), "official.?website|official.?site", ci=True)
    official = f"list_filter(important_links, lambda x: NOT {S.blank('x.url')} AND {site_rx})[1].url"
    levels = S.credential_levels("education")
    quals = q.strip_tags(S.nz("qualifications"))
    apply = "coalesce(apply_url, online_form, '')"
    vt = (f"CASE WHEN NOT {S.blank('last_date')} THEN last_date ELSE "
          f"strftime(DATE '{SITE.as_of}' + 90, '%Y-%m-%d') END || 'T23:59:59+05:30'")
    cols = {
        "title": "coalesce(title, '')",
        "url": S.derive_url("slug", "type"),
        "employment_type": S.employment_type("title", "salary_type", "type"),
        "direct_apply": f"CASE WHEN {S.direct_apply_flag('NULL', 'apply_url', 'online_form')} THEN 'true' ELSE 'false' END",
        "org_name": f"CASE WHEN {S.blank('organization')} THEN {S.s(SITE.name)} ELSE organization END",
        "org_url": f"coalesce({official}, {S.s(SITE.url)})",
        "location_type": f"CASE WHEN {lt} = 'TELECOMMUTE' THEN 'TELECOMMUTE' END",
        "region": f"CASE WHEN {lt} <> 'TELECOMMUTE' THEN {reg} END",
        "valid_through": vt,
        "min_value": f"CAST({lo} AS VARCHAR)",
        "max_value": f"CAST(CASE WHEN {hi} > 0 THEN {hi} ELSE greatest({lo}, 0) END AS VARCHAR)",
        "openings": f"CASE WHEN NOT {S.blank('total_posts')} THEN CAST({_int_sql('total_posts')} AS VARCHAR) END",
        "identifier": "CAST(post_id AS VARCHAR)",
        "description": _desc_expr(),
        "date_posted": f"CASE WHEN NOT {S.blank('notification_date')} THEN notification_date ELSE '{SITE.as_of}' END",
        "start": f"CASE WHEN NOT {S.blank('start_date')} THEN start_date END",
        "logo": S.s(SITE.url + "/images/logo.png"),
        "contact": f"CASE WHEN NOT {S.blank(apply)} THEN {apply} END",
        "qualifications": f"CASE WHEN NOT {S.blank('qualifications')} THEN {quals} END",
        "skills": f"CASE WHEN NOT {S.blank('skills')} THEN skills END",
        "responsibilities": f"CASE WHEN NOT {S.blank('responsibilities')} THEN responsibilities END",
        "applicants": f"CASE WHEN {lt} = 'TELECOMMUTE' THEN 'India' END",
        "street": f"CASE WHEN {lt} <> 'TELECOMMUTE' THEN {reg} END",
        "unit": "'MONTH'",
        "credentials": f"array_to_string(list_transform({levels}, lambda v: v || ': ' || CASE WHEN {quals} <> '' THEN {quals} ELSE v END), '|')",
        "edu_kind": f"CASE len({levels}) WHEN 0 THEN NULL WHEN 1 THEN 'object' ELSE 'array' END",
    }
    return W("post_id, " + ", ".join(f"{v} AS {k}" for k, v in cols.items()),
             src=f"(SELECT *, {_SLUG_SQL} AS slug FROM postings_raw)")


@register("r9_posting_jsonld", _r9_sql())
def q_r9(spark, sf_dir):
    p = R.posting_jsonld(N.derive_slug(_p(spark, sf_dir)), SITE)
    edu = F.get_json_object("posting_jsonld", "$.educationRequirements")
    cred = "struct<credentialCategory:string,description:string>"
    creds = F.when(edu.startswith("{"), F.array(F.from_json(edu, cred))).when(edu.startswith("["), F.from_json(edu, f"array<{cred}>"))
    said = F.transform(F.coalesce(creds, F.array().cast(f"array<{cred}>")), lambda c: F.concat(c["credentialCategory"], F.lit(": "), c["description"]))
    return p.select("post_id", *_jget(F.col("posting_jsonld"), _R9_PATHS), F.array_join(said, "|").alias("credentials"),
                    F.when(edu.startswith("{"), F.lit("object")).when(edu.startswith("["), F.lit("array"))
                    .alias("edu_kind"))


@register("r13_posting_summary", f"""WITH {S.postings_raw_cte()}
cats AS (SELECT * FROM (VALUES {", ".join(f"('{i}', {S.s(n)})" for i, n in rules.FALLBACK_CATEGORIES)}) AS c(cid, category)),
sts AS (SELECT * FROM (VALUES {", ".join(f"('{i}', {S.s(n)})" for i, n in rules.FALLBACK_STATES)}) AS s(sid, state))
SELECT post_id,
  CASE WHEN {_int_sql('total_posts')} > 0 THEN {S.indian_grouping(_int_sql('total_posts'))} ELSE '—' END AS vacancies,
  CASE WHEN coalesce(type, '') = '' THEN '—' ELSE {S.ucwords("replace(coalesce(type, ''), '_', ' ')")} END AS type_label,
  CASE WHEN {S.blank('last_date')} THEN '—' ELSE last_date END AS last_date,
  coalesce(c.category, '—') AS category, coalesce(s.state, 'All India') AS state,
  CASE WHEN {S.blank('salary')} THEN '—' ELSE salary END AS salary
FROM postings_raw p LEFT JOIN cats c ON c.cid = p.category_id LEFT JOIN sts s ON s.sid = p.state_id""")
def q_r13(spark, sf_dir):
    from gazette.sources.dims import dim_category_fallback, dim_state
    return R.posting_summary(_p(spark, sf_dir), dim_category_fallback(spark), dim_state(spark))


_R14_PATHS = [("title", "title"), ("datePosted", "date_posted"), ("directApply", "direct_apply"),
              ("hiringOrganization.name", "org_name"), ("jobLocation.address.addressRegion", "region"),
              ("validThrough", "valid_through"), ("baseSalary.value.description", "salary"),
              ("totalJobOpenings", "openings"), ("applicationContact.url", "apply_url")]


def _r14_sql():
    tp = _int_sql("total_posts")
    cols = {
        "title": "coalesce(title, '')",
        "date_posted": f"CASE WHEN {S.blank('notification_date')} THEN '{SITE.as_of}' ELSE notification_date END",
        "direct_apply": f"CASE WHEN NOT {S.blank('online_form')} THEN 'true' ELSE 'false' END",
        "org_name": f"CASE WHEN {S.blank('organization')} THEN 'Government of India' ELSE organization END",
        "region": f"CASE WHEN {S.blank('state_name')} THEN 'All India' ELSE state_name END",
        "valid_through": f"CASE WHEN NOT {S.blank('last_date')} THEN last_date || 'T23:59:59+05:30' END",
        "salary": f"CASE WHEN NOT {S.blank('salary')} THEN salary END",
        "openings": f"CASE WHEN {tp} <> 0 THEN CAST({tp} AS VARCHAR) END",
        "apply_url": f"CASE WHEN NOT {S.blank('online_form')} THEN online_form END",
    }
    return W("post_id, " + ", ".join(f"{v} AS {k}" for k, v in cols.items()))


@register("r14_client_jsonld", _r14_sql())
def q_r14(spark, sf_dir):
    p = _p(spark, sf_dir)
    doc = R.client_jsonld(N.derive_slug(p), SITE)
    return N.derive_slug(p).select("post_id", *_jget(doc, _R14_PATHS))


def _s7_sql():
    qq, aa = q.php_trim(S.nz("x.question")), q.php_trim(S.nz("x.answer"))
    items = f"list_filter(coalesce(faq, []), lambda x: {qq} <> '' AND {aa} <> '')"
    x = "valid[1]"
    first = lambda f: q.decode_entities(q.strip_tags(q.php_trim(S.nz(f"{x}.{f}"))))
    url = S.derive_url("slug", "type")
    name = "coalesce(category_name, 'jobs')"
    slug = f"lower(replace({name}, ' ', '-'))"
    return f"""WITH {S.postings_raw_cte()}
p AS (SELECT *, {items} AS valid FROM (SELECT *, {_SLUG_SQL} AS slug FROM postings_raw)),
d AS (SELECT post_id, 'posting' AS kind, 'JobPosting' AS doc_type, 1 AS n_items, coalesce(title, '') AS name, {url} AS url, NULL AS other FROM p
      UNION ALL SELECT post_id, 'breadcrumb', 'BreadcrumbList', 3, coalesce(title, 'Job Post'), {url}, {S.s(SITE.url + '/category/')} || {slug} FROM p
      UNION ALL SELECT post_id, 'faq', 'FAQPage', len(valid), {first('question')}, NULL, {first('answer')} FROM p WHERE len(valid) > 0)
SELECT post_id, kind, doc_type, n_items, name, url, other FROM d"""


@register("s7_jsonld_documents", _s7_sql())
def q_s7(spark, sf_dir):
    """The parsed documents: type, number of items, name, address and the part that differs by kind."""
    from gazette.sources.sinks import jsonld_documents
    docs = jsonld_documents(N.derive_slug(_p(spark, sf_dir, "conversations")), SITE)  # no kind of document reads FAQ and content
    get = lambda path: F.get_json_object("json", path)
    size = lambda path: F.coalesce(F.json_array_length(get(path)), F.lit(1))
    kind = F.col("kind")
    return docs.select(
        "post_id", "kind", get("$['@type']").alias("doc_type"),
        F.when(kind == "breadcrumb", size("$.itemListElement")).when(kind == "faq", size("$.mainEntity")).otherwise(1).alias("n_items"),
        F.coalesce(get("$.title"), get("$.itemListElement[2].name"), get("$.mainEntity[0].name")).alias("name"),
        F.coalesce(get("$.url"), get("$.itemListElement[2].item")).alias("url"),
        F.coalesce(get("$.itemListElement[1].item"), get("$.mainEntity[0].acceptedAnswer.text")).alias("other"))


# ---------------------------------------------------------------- S5, S6

@register("s5_load_dims", f"""WITH fallback AS (
  SELECT unnest([{', '.join(str(i) for i, _ in rules.FALLBACK_STATES)}]) AS id,
         unnest([{', '.join(S.s(n) for _, n in rules.FALLBACK_STATES)}]) AS name)
SELECT 'live' AS source, CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation
UNION ALL SELECT 'missing', CAST(id AS VARCHAR), name FROM fallback
UNION ALL SELECT 'repeated', CAST(min(p_partkey) AS VARCHAR), p_name FROM part GROUP BY p_name""")
def q_s5(spark, sf_dir):
    """A live table, a missing one (the fallback list) and one with repeated names made unique."""
    from gazette.sources.dims import dim_state, load_dim, unique_dim
    live = load_dim(spark, f"{sf_dir}/nation.parquet", dim_state(spark))
    missing = load_dim(spark, f"{sf_dir}/no_such_dimension.parquet", dim_state(spark))
    names = unique_dim(load_dim(spark, f"{sf_dir}/part.parquet", dim_state(spark)).select("p_name", "p_partkey"), "p_name", "p_partkey")
    rows = [("live", live, "n_nationkey", "n_name"), ("missing", missing, "id", "name"), ("repeated", names, "p_partkey", "p_name")]
    out = [d.select(F.lit(kind).alias("source"), F.col(i).cast("string").alias("id"), F.col(n).alias("name")) for kind, d, i, n in rows]
    return out[0].union(out[1]).union(out[2])


_REQUIRED = ["title", "type", "short_description", "content", "category_id"]


@register("s6_write_postings", f"""WITH {S.postings_raw_cte()}
g AS (SELECT *, {' OR '.join(S.blank(f) for f in _REQUIRED)} AS bad FROM postings_raw)
SELECT CASE WHEN bad THEN 'quarantine' ELSE 'postings' END AS place, type, count(*) AS n, CAST(sum(post_id) AS BIGINT) AS id_sum
FROM g GROUP BY ALL""")
def q_s6(spark, sf_dir):
    """Postings written by type next to the quarantine of rejected ones, then read back."""
    import uuid

    from gazette.operators import validate as V
    from gazette.session import shared_path
    from gazette.sources.sinks import write_postings
    gated = V.require_fields(_p(spark, sf_dir).select("post_id", *_REQUIRED))
    out = shared_path(spark, f"s6-{uuid.uuid4().hex}")
    write_postings(gated.filter("reject_reason is null"), gated.filter("reject_reason is not null"), out)
    back = [spark.read.parquet(f"{out}/{place}").select(F.lit(place).alias("place"), "type", "post_id") for place in ("postings", "quarantine")]
    return back[0].union(back[1]).groupBy("place", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("post_id").cast("long").alias("id_sum"))


# ---------------------------------------------------------------- E1 + E2 on the supplied documents (text mode, S2)

@register("e1_e2_documents", f"""WITH docs AS (SELECT doc_id, {q.php_trim('coalesce(text, chr(0))')} AS text FROM documents),
ok AS (SELECT doc_id, text, CAST([] AS VARCHAR[]) AS none FROM docs WHERE text <> '')
SELECT doc_id, array_to_string({S.detect_education('text', 'none')}, '|') AS education,
       array_to_string({S.detect_tags('text', 'none')}, '|') AS tags FROM ok""".replace("chr(0)", "''"))
def q_docs(spark, sf_dir):
    from gazette.sources.pages import gate_raw_text, split_rejects
    from gazette.session import read_table
    docs, _ = split_rejects(gate_raw_text(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
    docs = docs.withColumn("none", F.array().cast("array<string>"))
    docs = E.detect_tags(E.detect_education(docs, "text", current="none"), "text", current="none")
    return docs.select("doc_id", F.array_join("education", "|").alias("education"),
                       F.array_join("tags", "|").alias("tags"))

"""DuckDB spellings of the posting rules (oracle side)."""

from __future__ import annotations

from gazette.config import DEFAULT_SITE, SiteConfig
from gazette.functions import rules
from gazette.functions.regex import literal
from gazette.oracle import sqlfn as q
from gazette.oracle.fixtures_sql import postings_raw_cte

NO_DATE = "Check Notification"
# the spellings the fixtures use, as formats (the Spark side reads them with patterns)
DUCK_DATE_FORMATS = ["%Y-%m-%d", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%d-%m-%Y", "%d %B %Y", "%B %d, %Y", "%d-%b-%Y", "%Y%m%d",
                     "%m/%d/%Y", "%d.%m.%Y %H:%M", "%d.%m.%Y", "%Y/%m/%d", "%A, %d %b %Y"]
PAIR_REPL = "\\1,"  # RE2 replacement: group 1 then a comma


def with_postings(select: str, tail: str = "", src: str = "postings_raw") -> str:
    return f"WITH {postings_raw_cte()}\nbase AS (SELECT * FROM {src})\nSELECT {select} FROM base {tail}"


def s(x):
    return q.s(x)


def nz(e):
    return f"coalesce({e}, '')"


def blank(e):
    return q.is_blank_str(e)


def lint(e):
    return q.leading_int(f"CAST({e} AS VARCHAR)")


def parse_date(e):
    fmts = "[" + ", ".join(s(f) for f in DUCK_DATE_FORMATS) + "]"
    return f"CAST(try_strptime({q.php_trim(nz(e))}, {fmts}) AS DATE)"


def safe_date(e, fallback=NO_DATE):
    d = parse_date(e)
    return f"(CASE WHEN {d} IS NULL OR {d} < DATE '2000-01-01' THEN {s(fallback)} ELSE strftime({d}, '%d-%m-%Y') END)"


def deadline_text(ld, tm):
    base = safe_date(ld, "Apply Soon")
    return f"(CASE WHEN NOT {blank(tm)} THEN {base} || ' by ' || {tm} ELSE {base} END)"


def deadline_text_table(ld, tm):
    base = safe_date(ld)
    return f"(CASE WHEN {base} <> {s(NO_DATE)} AND NOT {blank(tm)} THEN {base} || ' (by ' || {tm} || ')' ELSE {base} END)"


def sanitize_total_posts(e):
    v = f"CAST({e} AS VARCHAR)"
    run = q.rext(v, "([0-9]+)")
    return (f"(CASE WHEN {q.is_numeric(v)} THEN greatest(0::BIGINT, {q.leading_int(v)}) "
            f"WHEN {run} <> '' THEN TRY_CAST({run} AS BIGINT) ELSE 0::BIGINT END)")


def salary_range(mn_e, mx_e, sal):
    mn, mx = f"coalesce({lint(mn_e)}, 0)", f"coalesce({lint(mx_e)}, 0)"
    nums = f"list_transform(regexp_extract_all(replace({nz(sal)}, ',', ''), '([0-9]+)', 1), lambda x: TRY_CAST(x AS BIGINT))"
    use = f"({mn} = 0 AND {mx} = 0 AND NOT {blank(sal)} AND len({nums}) > 0)"
    lo = f"(CASE WHEN {use} THEN list_min({nums}) ELSE {mn} END)"
    hi = f"(CASE WHEN {use} THEN list_max({nums}) ELSE {mx} END)"
    return lo, f"greatest({hi}, {lo})"


def salary_text(sal, mn):
    base = f"(CASE WHEN {blank(sal)} THEN {s(NO_DATE)} ELSE {sal} END)"
    m = lint(mn)
    return (f"(CASE WHEN NOT {blank(f'CAST({mn} AS VARCHAR)')} AND {m} > 0 THEN {base} || ' (₹' || "
            f"format('{{:,}}', {m}) || '/month)' ELSE {base} END)")


def employment_type(title, st, typ):
    t = f"lower({nz(title)})"
    return (f"(CASE WHEN contains({t}, 'apprentice') OR contains({t}, 'trainee') OR {nz(st)} = 'stipend' THEN 'INTERN' "
            f"WHEN contains({t}, 'contract') THEN 'CONTRACTOR' "
            f"WHEN contains({t}, 'part time') OR {nz(typ)} = 'scholarship' THEN 'PART_TIME' "
            f"WHEN contains({t}, 'volunteer') THEN 'VOLUNTEER' WHEN contains({t}, 'temporary') THEN 'TEMPORARY' "
            f"ELSE 'FULL_TIME' END)")


def direct_apply_flag(flag, apply_url, online_form):
    cand = f"coalesce({apply_url}, {online_form}, '')"
    p = q.url_path(cand)
    path = q.rrep(f"(CASE WHEN {p} = '' THEN '/' ELSE {p} END)", "/+$", "")
    isd = f"(NOT {blank(cand)} AND {path} <> '' AND NOT {blank(q.url_query(cand))})"
    return f"coalesce(CAST({flag} AS BOOLEAN), {isd})"


def norm_form_url(e):
    u = q.with_scheme(e)
    return (f"(CASE WHEN {blank(e)} THEN {e} WHEN NOT {q.is_valid_url(u)} THEN '' "
            f"WHEN {q.is_apply_url_bare(u)} THEN '' ELSE {u} END)")


def _map(pairs):
    return "MAP {" + ", ".join(f"{s(k)}: {s(v)}" for k, v in pairs) + "}"


def organization_cut(title):
    return q.php_trim(q.rrep(nz(title), rules.ORG_CUT_PATTERN, "", ci=True))


def resolve_organization(org, title):
    cut = organization_cut(title)
    first = f"upper({q.rrep(f'string_split({cut}, chr(32))[1]', '[^A-Za-z]', '')})"
    full = f"{_map(rules.ORG_ABBREVIATIONS)}[{first}]"
    derived = (f"(CASE WHEN {first} <> '' AND {full} IS NOT NULL THEN {full} "
               f"WHEN strlen({cut}) >= 3 THEN {cut} ELSE {s(rules.ORG_DEFAULT)} END)")
    return f"(CASE WHEN {blank(org)} THEN {derived} ELSE {org} END)"


def year_in(text, default):
    y = q.rext(text, r"\b(20[0-9]{2})\b")
    return f"(CASE WHEN {y} <> '' THEN {y} ELSE {s(default)} END)"


def derive_slug(org, title, summary, total, site: SiteConfig = DEFAULT_SITE):
    o = f"(CASE WHEN {blank(org)} THEN {s(rules.SLUG_ORG_DEFAULT)} ELSE {org} END)"
    o = f"array_to_string(list_slice(string_split({o}, ' '), 1, 3), ' ')"
    post = f"coalesce({title}, 'job')"
    year = year_in(f"{post} || ' ' || {nz(summary)}", site.as_of_year)
    body = f"({o} || ' ' || {post})"
    for f in rules.SLUG_FILLERS:
        body = q.rrep(body, r"\b" + literal(f) + r"\b", "", ci=True)
    vac = f"coalesce({lint(total)}, 0)"
    base = (f"{q.php_trim(body)} || ' recruitment ' || {year} || "
            f"(CASE WHEN {vac} > 0 THEN ' ' || CAST({vac} AS VARCHAR) || ' posts' ELSE '' END)")
    slug = f"lower({q.rrep(q.rrep(base, '[^a-zA-Z0-9]+', '-'), '^-+|-+$', '')})"
    return q.rrep(f"substring({slug}, 1, {rules.SLUG_MAX_BYTES})", "-+$", "")


def derive_url(slug, typ, site: SiteConfig = DEFAULT_SITE):
    return f"(CASE WHEN {blank(slug)} THEN {s(site.url)} ELSE concat_ws('/', {s(site.url)}, coalesce({typ}, 'job'), {slug}) END)"


def age_display():
    gen, mn = lint("age_max_gen"), lint("age_min")
    head = f"(CASE WHEN {mn} > 0 THEN CAST({mn} AS VARCHAR) || ' – ' ELSE '' END) || CAST({gen} AS VARCHAR) || ' Yrs (Gen)'"
    asof = parse_date("age_as_on_date")
    parts = (f"concat_ws(' | ', CASE WHEN {lint('age_max_obc')} > 0 THEN 'OBC: ' || age_max_obc || ' Yrs' END, "
             f"CASE WHEN {lint('age_max_sc')} > 0 THEN 'SC/ST: ' || age_max_sc || ' Yrs' END, "
             f"CASE WHEN {lint('age_max_ph')} > 0 THEN 'PwD: ' || age_max_ph || ' Yrs' END, "
             f"CASE WHEN NOT {blank('age_as_on_date')} AND {asof} IS NOT NULL THEN 'As on: ' || strftime({asof}, '%d-%m-%Y') END)")
    full = f"(CASE WHEN {parts} <> '' THEN {head} || ' | ' || {parts} ELSE {head} END)"
    return f"(CASE WHEN {gen} > 0 THEN {full} ELSE {s(NO_DATE)} END)"


def age_label_short(mn_e, mx_e):
    mn, mx = lint(mn_e), lint(mx_e)
    return (f"(CASE WHEN {mn} = 0 THEN '-' ELSE CAST({mn} AS VARCHAR) || ' – ' || "
            f"(CASE WHEN {mx} = 0 THEN '?' ELSE CAST({mx} AS VARCHAR) END) || ' Years' END)")


def education_label(edu):
    m = _map(rules.EDUCATION_SHORT_LABELS)
    labels = f"list_transform(list_slice(coalesce({edu}, []), 1, 3), lambda e: coalesce({m}[e], e))"
    return f"(CASE WHEN len(coalesce({edu}, [])) = 0 THEN 'Various' ELSE array_to_string({labels}, ', ') END)"


def location_kind(st):
    region = f"(CASE WHEN {blank(st)} THEN 'All India' ELSE {q.php_trim(st)} END)"
    remote = f"({region} = '' OR {region} = 'All India')"
    return (f"(CASE WHEN {remote} THEN 'TELECOMMUTE' ELSE 'PLACE' END)",
            f"(CASE WHEN {remote} THEN 'India' ELSE {region} END)")


def ucwords(e):
    return f"array_to_string(list_transform(string_split({e}, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"


def codes(text, rule_list):
    parts = ", ".join(f"CASE WHEN {q.rlike(text, rx)} THEN {s(code)} END" for code, rx in rule_list)
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


def distinct_keep_order(lst):
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


def detect_education(text, current):
    lt = f"lower({nz(text)})"
    det = codes(lt, rules.EDUCATION_RULES)
    masters = "[" + ", ".join(s(x) for x in rules.EDUCATION_MASTERS) + "]"
    bach = "[" + ", ".join(s(x) for x in rules.EDUCATION_BACHELORS) + "]"
    return f"""(SELECT CASE WHEN len(coalesce({current}, [])) > 0 THEN {current}
        WHEN len(d3) = 0 THEN ['graduate'] ELSE d3 END FROM (
      SELECT {distinct_keep_order('d2')} AS d3 FROM (
        SELECT CASE WHEN m AND NOT b THEN list_filter(d1, lambda x: x <> 'graduate') ELSE d1 END AS d2 FROM (
          SELECT m, b, CASE WHEN b AND NOT list_contains(d0, 'graduate') THEN list_append(d0, 'graduate') ELSE d0 END AS d1 FROM (
            SELECT m, b, CASE WHEN m AND NOT list_contains(d, 'post_graduate') THEN list_append(d, 'post_graduate') ELSE d END AS d0 FROM (
              SELECT d, len(list_intersect(d, {masters})) > 0 AS m,
                     (len(list_intersect(d, {bach})) > 0 OR {q.rlike(nz(text), rules.EDUCATION_DEGREE_WORDS, ci=True)}) AS b
              FROM (SELECT {det} AS d)))))))"""


def detect_tags(text, current):
    cur = f"list_filter(coalesce({current}, []), lambda x: x IS NOT NULL)"
    allt = f"list_concat({cur}, {codes(f'lower({nz(text)})', rules.TAG_RULES)})"
    return f"(SELECT {distinct_keep_order('a')} FROM (SELECT {allt} AS a))"


def update_signals(src):
    joined = f"concat_ws(chr(32), {nz('title')}, {nz('short_description')}, {nz('content')}, {nz(src)})"
    combined = f"lower({q.php_trim(joined)})"
    sig = codes("lt", rules.SIGNAL_RULES)
    typ = nz("type")
    tt = (f"(CASE WHEN {typ} = 'admit_card' THEN ['admit_card'] WHEN {typ} = 'answer_key' THEN ['answer_key'] "
          f"WHEN {typ} = 'syllabus' THEN ['syllabus'] WHEN {typ} = 'result' THEN ['final_result'] "
          f"WHEN {typ} = 'job' THEN CASE WHEN {lint('total_posts')} > 0 THEN ['govt_job', 'new_vacancy'] ELSE ['govt_job'] END "
          f"ELSE CAST([] AS VARCHAR[]) END)")
    tags = f"list_concat(coalesce(tags, []), {sig}, {tt})"
    ext = q.rlike("lt", rules.SIGNAL_RULES[0][1])
    return (f"(SELECT {distinct_keep_order('a')} FROM (SELECT {tags} AS a FROM (SELECT {combined} AS lt)))",
            f"(SELECT {ext} OR coalesce(CAST(is_date_extended AS BOOLEAN), false) FROM (SELECT {combined} AS lt))")


def default_tags():
    src = f"{nz('title')} || ' ' || {nz('short_description')} || ' ' || {q.strip_tags(nz('content'))}"
    det = detect_tags(src, "CAST([] AS VARCHAR[])")
    typ = "coalesce(type, 'job')"
    dflt = "['" + "', '".join(rules.DEFAULT_TAGS_OTHER) + "']"
    for t, tags in rules.DEFAULT_TAGS_BY_TYPE:
        dflt = f"(CASE WHEN {typ} = {s(t)} THEN ['" + "', '".join(tags) + f"'] ELSE {dflt} END)"
    filled = f"(SELECT {distinct_keep_order('a')} FROM (SELECT list_concat({dflt}, {det}) AS a))"
    return f"(CASE WHEN len(coalesce(tags, [])) = 0 THEN {filled} ELSE tags END)"


def any_contains(text, words):
    return "(" + " OR ".join(f"contains({text}, {s(w)})" for w in words) + ")"


def correct_category():
    lt = f"lower(concat_ws(' ', {nz('organization')}, {nz('title')}, {nz('short_description')}))"
    psu = any_contains(lt, rules.PSU_WORDS)
    central = f"(category_name = {s(rules.STATE_CATEGORY)} AND {any_contains(lt, rules.CENTRAL_WORDS)})"
    cat = (f"(CASE WHEN {psu} THEN {s(rules.PSU_CATEGORY)} WHEN {central} THEN {s(rules.CENTRAL_CATEGORY)} "
           f"ELSE category_name END)")
    st = f"(CASE WHEN {psu} OR {central} THEN {s(rules.ALL_INDIA)} ELSE state_name END)"
    return cat, st


def category_id(cid, name):
    m = "MAP {" + ", ".join(f"{s(k)}: {v}" for k, v in rules.CATEGORY_IDS) + "}"
    c = f"CAST({cid} AS VARCHAR)"
    base = (f"(CASE WHEN NOT {blank(c)} THEN {q.leading_int(c)} WHEN NOT {blank(name)} THEN "
            f"coalesce({m}[{name}], {rules.CATEGORY_DEFAULT_ID}) ELSE {rules.CATEGORY_DEFAULT_ID} END)")
    return f"CAST(coalesce({m}[{name}], {base}) AS BIGINT)"


def credential_levels(edu):
    m = _map(rules.CREDENTIAL_LEVELS)
    lst = f"list_filter(list_transform(coalesce({edu}, []), lambda e: {m}[e]), lambda x: x IS NOT NULL)"
    return f"(SELECT {distinct_keep_order('a')} FROM (SELECT {lst} AS a))"


def html_escape(e):
    out = f"replace({e}, '&', '&amp;')"
    for a, b in [('"', "&quot;"), ("'", "&#039;"), ("<", "&lt;"), (">", "&gt;")]:
        out = f"replace({out}, {s(a)}, {s(b)})"
    return out


def indian_grouping(n):
    sv = f"CAST(CAST({n} AS BIGINT) AS VARCHAR)"
    head = f"substring({sv}, 1, greatest(length({sv}) - 3, 0))"
    grouped = f"reverse({q.rrep(q.rrep(f'reverse({head})', '([0-9]{2})', PAIR_REPL), ',$', '')})"
    return f"(CASE WHEN length({sv}) <= 3 THEN {sv} ELSE {grouped} || ',' || right({sv}, 3) END)"


PUBLISHED_TEXT = ["title", "type", "short_description", "content_md5", "salary_type", "category_warning", "deadline_time", "apply_url",
                  "qualifications", "skills", "notification_pdf", "gate_note", "post_name", "interview_date_from", "waitlist_date"]


def prepare_publish_sql(site: SiteConfig = DEFAULT_SITE) -> str:
    """V3 twin: the publish steps in the same order as ``plans.publish.prepare_publish``."""
    from gazette.oracle import sqlfn as q2
    cmap = "MAP {" + ", ".join(f"{s(k)}: {v}" for k, v in rules.CATEGORY_IDS) + "}"
    c = "CAST(category_id AS VARCHAR)"
    cid0 = (f"(CASE WHEN NOT {blank(c)} THEN {q2.leading_int(c)} WHEN NOT {blank('category_name')} THEN "
            f"coalesce({cmap}[category_name], {rules.CATEGORY_DEFAULT_ID}) ELSE {rules.CATEGORY_DEFAULT_ID} END)")
    req = ["title", "type", "short_description", "content", "category_id"]
    reason = "CASE " + " ".join(f"WHEN {blank(f'CAST({f} AS VARCHAR)')} THEN 'Required field missing: {f}'"
                                for f in req) + " END"
    links20 = f"list_filter(important_links, lambda x: NOT {blank('x.title')} AND NOT {blank('x.url')})"
    from gazette.operators.normalize import INT_FIELDS, OPTIONAL_FIELDS
    ints = [f"CASE WHEN {blank(f) if f == 'total_posts' else f'{f} IS NULL'} THEN NULL ELSE {lint(f)} END AS {f}" for f in INT_FIELDS]
    kept = [f"CASE WHEN {f} = '' THEN NULL ELSE {f} END AS {f}" for f in OPTIONAL_FIELDS]
    stip = (f"(lower(coalesce(salary_type, 'salary')) = 'stipend' OR contains(lower({nz('salary')}), 'stipend') OR "
            f"{q2.rlike('lower(' + nz('title') + ')', 'trainee|intern|apprentice')})")
    salary = (f"CASE WHEN {stip} AND NOT {blank('salary')} AND NOT contains(lower({nz('salary')}), 'stipend') "
              f"THEN 'Stipend: ' || salary ELSE salary END")
    salary_type = f"CASE WHEN {stip} THEN 'stipend' ELSE salary_type END"
    more = ", ".join(INT_FIELDS + OPTIONAL_FIELDS + PUBLISHED_TEXT)
    none = ", ".join(["NULL::BIGINT"] * len(INT_FIELDS) + ["NULL::VARCHAR"] * (len(OPTIONAL_FIELDS) + len(PUBLISHED_TEXT)))
    slug = derive_slug("organization", "title", "short_description", "total_posts", site)
    src = f"{nz('title')} || ' ' || {nz('short_description')} || ' ' || {q2.strip_tags(nz('content'))}"
    cat, _ = correct_category()
    tmap = "MAP {" + ", ".join(f"{s(k)}: {s(v)}" for k, v in rules.TYPE_CATEGORY) + "}"
    y = site.as_of_year
    items = (f"[{nz('organization')}, {nz('title')}, {nz('organization')} || ' recruitment {y}', "
             f"{nz('title')} || ' {y}', 'sarkari naukri', 'govt jobs', coalesce(state_name, 'India') || ' govt jobs {y}', "
             f"'apply online', 'last date', 'notification', 'vacancy', 'sarkari result', 'free job alert']")
    kw = f"array_to_string(list_filter({items}, lambda x: NOT {blank('x')}), ', ')"
    pdf = ("CASE WHEN NOT {b} AND {v} AND len(list_filter(important_links, lambda x: NOT {bu} AND "
           "lower(x.url) = lower(notification_pdf))) = 0 THEN list_prepend({{'title': 'Official Notification PDF', "
           "'url': notification_pdf}}, important_links) ELSE important_links END").format(
        b=blank("notification_pdf"), v=q2.is_valid_url("notification_pdf"), bu=blank("x.url"))
    links_text = "array_to_string(list_transform(important_links, lambda x: x.title || ' <' || x.url || '>'), ' | ')"
    return f"""WITH {postings_raw_cte()}
a AS (SELECT * REPLACE (CAST({cid0} AS BIGINT) AS category_id) FROM postings_raw),
g AS (SELECT *, {reason} AS reject_reason FROM a),
ok AS (SELECT * REPLACE ({links20} AS important_links, {', '.join(ints + kept)}) FROM g WHERE reject_reason IS NULL),
sl AS (SELECT *, {slug} AS slug FROM ok),
org AS (SELECT * REPLACE ({resolve_organization('organization', 'title')} AS organization) FROM sl),
ed AS (SELECT * REPLACE ({detect_education(src, 'education')} AS education, {default_tags()} AS tags) FROM org),
cc AS (SELECT * REPLACE ({cat} AS category_name) FROM ed),
ci AS (SELECT * REPLACE (CAST(coalesce({cmap}[category_name], category_id) AS BIGINT) AS category_id) FROM cc),
kw AS (SELECT * REPLACE (CASE WHEN {blank('meta_keywords')} THEN {kw} ELSE meta_keywords END AS meta_keywords,
                         {pdf} AS important_links, {salary} AS salary, {salary_type} AS salary_type),
              md5(content) AS content_md5, CASE WHEN {tmap}[coalesce(type, 'job')] IS NOT NULL AND {cmap}[{tmap}[coalesce(type, 'job')]] IS NULL
                   THEN 'category not in dimension: ' || {tmap}[coalesce(type, 'job')] END AS category_warning
       FROM (SELECT * REPLACE (CAST(coalesce({cmap}[{tmap}[coalesce(type, 'job')]], category_id) AS BIGINT) AS category_id) FROM ci))
SELECT post_id, NULL::VARCHAR AS reject_reason, slug, organization, category_id,
       array_to_string(tags, '|') AS tags, array_to_string(education, '|') AS education, meta_keywords,
       {links_text} AS links, {more} FROM kw
UNION ALL
SELECT post_id, reject_reason, NULL, NULL, NULL::BIGINT, NULL, NULL, NULL, NULL, {none} FROM g WHERE reject_reason IS NOT NULL"""

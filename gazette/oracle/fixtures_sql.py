"""SQL twins of the derived inputs in ``gazette.plans.fixtures`` (used as leading CTEs)."""

from __future__ import annotations

from gazette.oracle import sqlfn as q
from gazette.plans import fixtures as FX


def _list(values: list[str]) -> str:
    return "[" + ", ".join(q.s(v) for v in values) + "]"


def pages_ext_cte(name: str = "pages_ext", src: str = "pages") -> str:
    k = "(page_id % 16) + 1"
    html = f"replace(html, '<body>', '<body>' || {_list(FX.BODY_SNIPPETS)}[{k}])"
    html = f"replace({html}, '</head>', {_list(FX.HEAD_SNIPPETS)}[{k}] || '</head>')"
    html = f"replace({html}, '</body>', {_list(FX.TAIL_SNIPPETS)}[{k}] || '</body>')"
    return f"{name} AS (SELECT page_id, url, {html} AS html FROM {src}),"


def pages_url_variants_cte(name: str = "pages_urls", src: str = "pages") -> str:
    no_scheme = q.rrep("url", "^[A-Za-z]+://", "")
    return f"""{name} AS (
  SELECT page_id,
         CASE page_id % 7 WHEN 0 THEN {no_scheme}
              WHEN 1 THEN '  ' || url || ' ' || chr(10)
              WHEN 2 THEN '   '
              WHEN 3 THEN 'https://bad_host.' || {no_scheme}
              WHEN 4 THEN '//' || {no_scheme}
              WHEN 5 THEN url || '/caf' || chr(233)
              ELSE url END AS url, html
  FROM {src}),"""


def _pick(values, idx: str) -> str:
    items = ", ".join("NULL::VARCHAR" if v is None else q.s(v) for v in values)
    return f"([{items}][{idx} + 1])"


def postings_raw_cte(name: str = "postings_raw") -> str:
    """B2 twin: one model-shaped posting per order."""
    k = "o.o_orderkey"

    def m(n):
        return f"CAST({k} % {n} AS INTEGER)"

    def date_field(off):
        base = f"(CASE WHEN {k} % 19 = 0 THEN od ELSE CAST(od + INTERVAL 28 YEAR AS DATE) END)"
        spelt = ", ".join(f"strftime(CAST({base} + {off} AS DATE), {q.s(f)})" for f in FX.DATE_SPELLINGS_SQL)
        real = f"([{spelt}][({k} + {abs(off)}) % {len(FX.DATE_SPELLINGS)} + 1])"
        return f"(CASE WHEN {k} % 13 = 0 THEN '' WHEN {k} % 17 = 0 THEN 'As per notice' ELSE {real} END)"

    org = f"replace({_pick(FX.ORGANIZATIONS, m(9))}, '{{nation}}', coalesce(n.n_name, ''))"
    title = (f"concat_ws(' ', p.p_name, {_pick(FX.TITLE_SUFFIXES, m(6))}, CAST(2020 + {k} % 7 AS VARCHAR), "
             f"CASE WHEN {k} % 4 = 0 THEN '- ' || CAST({k} % 500 AS VARCHAR) || ' Posts' END)")
    content = f"'<h3>Overview</h3><p>' || coalesce(d.text, '') || '</p>' || {_pick(FX.CONTENT_EXTRAS, m(5))}"
    pool = "[" + ", ".join(f"{{'title': {q.s(t)}, 'url': {q.s(u)}}}" for t, u in FX.LINK_POOL * 2) + "]"
    extra = "[" + ", ".join(f"{{'question': {q.s(a)}, 'answer': {q.s(b)}}}" for a, b in FX.FAQ_EXTRAS) + "]"
    empty_faq = "CAST([] AS STRUCT(question VARCHAR, answer VARCHAR)[])"
    faq = (f"list_concat(coalesce(f.faq, {empty_faq}), CASE WHEN {m(7)} < 3 THEN "
           f"list_slice({extra}, {m(7)} + 1, {m(7)} + 1) ELSE {empty_faq} END)")
    stages = "[" + ", ".join(q.s(s) for s in FX.STAGES) + "]"
    dates = ",\n    ".join(f"{date_field(off)} AS {nm}" for nm, off in FX.DATE_OFFSETS)
    return f"""faq_src AS (
  SELECT conv_id, role, turn, text,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
         lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
  FROM conversations),
faq_by_conv AS (
  SELECT conv_id, list({{'question': text, 'answer': CASE WHEN next_role = 'assistant' THEN next_text ELSE '' END}}
                       ORDER BY turn) AS faq
  FROM faq_src WHERE role = 'user' GROUP BY conv_id),
{name} AS (
  SELECT {k} AS post_id,
    {_pick(FX.POSTING_TYPES, m(7))} AS type,
    {org} AS organization,
    {title} AS title,
    CASE WHEN {m(3)} = 0 THEN p.p_name END AS post_name,
    {_pick(FX.SUMMARIES, m(10))} AS short_description,
    {content} AS content,
    {_pick(FX.CATEGORY_NAMES, m(6))} AS category_name,
    CASE WHEN {m(3)} = 0 THEN n.n_name WHEN {m(3)} = 1 THEN 'All India' ELSE '' END AS state_name,
    {dates},
    '' AS end_date, '' AS interview_date_to,
    CASE WHEN {m(2)} = 0 THEN '' ELSE '4:00 PM' END AS deadline_time,
    {_pick(FX.TOTAL_POSTS, m(9))} AS total_posts,
    CASE WHEN {k} % 11 = 0 THEN '12abc' ELSE CAST({k} % 50 AS VARCHAR) END AS vacancy_gen,
    CAST({k} % 20 AS VARCHAR) AS vacancy_obc, CAST({k} % 10 AS VARCHAR) AS vacancy_sc,
    CAST({k} % 5 AS VARCHAR) AS vacancy_st, CAST({k} % 7 AS VARCHAR) AS vacancy_ews,
    CAST({k} % 3 AS VARCHAR) AS vacancy_ph,
    CASE WHEN {k} % 4 = 0 THEN '0' ELSE CAST(({k} % 5) * 100 AS VARCHAR) END AS fee_general,
    CASE WHEN {k} % 4 = 0 THEN '0' ELSE CAST(({k} % 5) * 50 AS VARCHAR) END AS fee_obc,
    CASE WHEN {k} % 3 = 0 THEN '0' ELSE '25' END AS fee_sc_st,
    CASE WHEN {k} % 2 = 0 THEN '0' ELSE '50' END AS fee_women,
    '0' AS fee_ph,
    CASE WHEN {k} % 5 = 0 THEN '0' ELSE CAST(18 + {k} % 3 AS VARCHAR) END AS age_min,
    CASE WHEN {k} % 6 = 0 THEN '' ELSE CAST(27 + {k} % 10 AS VARCHAR) END AS age_max_gen,
    CAST(30 + {k} % 3 AS VARCHAR) AS age_max_obc, CAST(32 + {k} % 3 AS VARCHAR) AS age_max_sc,
    CASE WHEN {k} % 4 = 0 THEN '0' ELSE CAST(37 + {k} % 3 AS VARCHAR) END AS age_max_ph,
    '0' AS age_max_ex_serviceman,
    CASE WHEN {k} % 3 = 0 THEN '0' ELSE CAST(20000 + ({k} % 10) * 1000 AS VARCHAR) END AS salary_min,
    CASE WHEN {k} % 3 = 0 THEN '0' ELSE CAST(60000 + ({k} % 10) * 1000 AS VARCHAR) END AS salary_max,
    {_pick(FX.SALARIES, m(4))} AS salary,
    {_pick(FX.SALARY_TYPES, m(5))} AS salary_type,
    {_pick(FX.ONLINE_FORMS, m(5))} AS online_form,
    {_pick(FX.APPLY_URLS, m(4))} AS apply_url,
    {_pick(FX.NOTIFICATION_PDFS, m(4))} AS notification_pdf,
    '' AS final_result,
    list_slice({stages}, 1, {m(4)}) AS selection_stages,
    CASE WHEN {m(4)} = 0 THEN ['graduate', 'btech', 'xyz_unknown'] ELSE CAST([] AS VARCHAR[]) END AS education,
    CASE WHEN {m(4)} = 0 THEN ['govt_job', 'bogus_tag'] ELSE CAST([] AS VARCHAR[]) END AS tags,
    {_pick(FX.QUALIFICATIONS, m(13))} AS qualifications,
    list_slice({pool}, {m(12)} + 1, {m(12)} + {m(5)}) AS important_links,
    {faq} AS faq,
    {_pick(FX.META_KEYWORDS, m(3))} AS meta_keywords,
    CASE WHEN {m(5)} = 0 THEN '' ELSE CAST({k} % 18 AS VARCHAR) END AS category_id,
    CASE WHEN {m(4)} = 0 THEN '' ELSE CAST({k} % 32 AS VARCHAR) END AS state_id,
    {_pick(FX.SOURCE_URLS, m(3))} AS source_url,
    ({k} % 10 = 0) AS is_date_extended,
    CASE WHEN {m(8)} = 0 THEN 'GATE score used for shortlisting only' ELSE '' END AS gate_note,
    CASE WHEN {m(2)} = 0 THEN 'Typing' ELSE '' END AS skills,
    '' AS responsibilities, '' AS featured_image, '' AS meta_title, '' AS meta_description,
    NULL::VARCHAR AS exam_date, NULL::VARCHAR AS result_date
  FROM (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS od FROM orders) o
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN part p ON p.p_partkey = {k} % (SELECT count(*) FROM part)
  LEFT JOIN documents d ON d.doc_id = {k} % (SELECT count(*) FROM documents)
  LEFT JOIN faq_by_conv f ON f.conv_id = {k} % (SELECT count(DISTINCT conv_id) FROM conversations)),"""


def responses_cte(name: str = "responses") -> str:
    """B3 twin (needs postings_raw_cte before it)."""
    parts = []
    for c in FX.RESPONSE_BODY_FIELDS:
        v = c if c in ("tags", "education", "important_links", "faq") else f"coalesce({c}, '')"
        parts.append(f"{q.s(c)}: {v}")
    body = "CAST(to_json({" + ", ".join(parts) + "}) AS VARCHAR)"
    return f"""resp_full AS (SELECT post_id, {body} AS full_body FROM postings_raw),
{name} AS (
  SELECT post_id AS response_id, post_id % (SELECT count(*) FROM pages) AS page_id,
    CASE WHEN post_id % 50 = 49 THEN {q.s(FX.NOT_JSON)}
         WHEN post_id % 50 = 44 THEN full_body || ' extra'
         WHEN post_id % 50 = 39 THEN full_body || '}}'
         WHEN post_id % 50 = 34 THEN '{{"title":"first","total_posts":"7",' || substring(full_body, 2)
         WHEN post_id % 5 = 0 THEN '```json' || chr(10) || full_body || chr(10) || '```'
         WHEN post_id % 5 = 1 THEN substring(full_body, 1, CAST((length(full_body) * 3) // 5 AS INTEGER))
         WHEN post_id % 5 = 2 THEN substring(full_body, 1, strpos(full_body, '"title":"') + 11)
         WHEN post_id % 5 = 3 AND comma > 0 THEN substring(full_body, 1, comma)
         ELSE full_body END AS body
  FROM (SELECT *, CASE WHEN strpos(substring(full_body, CAST(trunc(length(full_body) / 2) AS INTEGER) + 1), ',') > 0
                       THEN strpos(substring(full_body, CAST(trunc(length(full_body) / 2) AS INTEGER) + 1), ',')
                            + CAST(trunc(length(full_body) / 2) AS INTEGER) ELSE 0 END AS comma
        FROM resp_full)),"""


def repair_sql(s: str) -> str:
    """S4 twin: a list_reduce over the characters with (in string, escaped, closers) state."""
    t = q.rrep(s, "[, ]+$", "")
    step = ("lambda a, c: CASE WHEN a.e THEN {'i': a.i, 'e': false, 'st': a.st} "
            "WHEN c = chr(92) AND a.i THEN {'i': a.i, 'e': true, 'st': a.st} "
            "WHEN c = '\"' THEN {'i': NOT a.i, 'e': false, 'st': a.st} "
            "WHEN a.i THEN a "
            "WHEN c = '{' THEN {'i': false, 'e': false, 'st': a.st || '}'} "
            "WHEN c = '[' THEN {'i': false, 'e': false, 'st': a.st || ']'} "
            "WHEN c = '}' OR c = ']' THEN {'i': false, 'e': false, 'st': substring(a.st, 1, greatest(length(a.st) - 1, 0))} "
            "ELSE a END")
    acc = f"list_reduce(string_split({t}, ''), {step}, {{'i': false, 'e': false, 'st': ''}})"
    return f"(SELECT tt || CASE WHEN a.i THEN '\"' ELSE '' END || reverse(a.st) FROM (SELECT {t} AS tt, {acc} AS a))"

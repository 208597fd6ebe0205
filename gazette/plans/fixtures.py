"""Derived inputs (FIXTURES.md §B), built by Spark from the supplied tables.

Each derivation is deterministic (key modulo, literal lists) and has a SQL
twin in ``gazette.oracle.fixtures_sql`` so the oracle sees the same rows.
The supplied ``pages`` exercise few rule branches (every link is site-relative,
no images, no type keywords); ``pages_ext`` places one snippet after ``<body>``,
one meta in the head and one block before ``</body>``, chosen by ``page_id % 16``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Test snippets, indexed by page_id % 16 (ASCII only).
BODY_SNIPPETS = [
    '<p><a href="https://ssc.nic.in/apply?post=1">Click here</a> and <a href="https://www.upsc.gov.in/">UPSC portal</a>'
    ' <a href="https://sbi.co.in/web/careers/notification-2024">Notification</a></p>',
    '<a href="https://www.freejobalert.com/x">FJA</a><a href="http://m.naukri.com/jobs">Naukri jobs</a>'
    '<a href="https://jobs.example.org/latest">Own portal</a>',
    '<a href="https://files.example-notices.in/advt/2024/notice.PDF">10</a>',
    '<a href="https://blog.randomsite.com/post/1">Some other blog</a><a href="https://careers.abc.co.in/open">ABC</a>',
    '<a href="https://rbi.org.in/Scripts/Result.aspx">Result page</a>'
    '<a href="https://RBI.org.in/scripts/result.aspx">Result page again</a>',
    '<a href="//cdn.isro.gov.in/files/syllabus.html">x</a><a href="docs/file.html">Relative doc</a>'
    '<a href="https://www.isro.gov.in:8443/walkin/interview">Walk in</a>',
    '<a href="mailto:a@b.com">Mail</a><a href="tel:123">Call</a><a href="javascript:void(0)">JS</a>'
    '<a href="#top">Top</a><a href=" /spaced">Spaced</a>',
    '<a href="https://ibps.in/?a=1&amp;b=2">IBPS &amp; <b>more</b></a>',
    '<a href="https://drdo.gov.in/login">12345</a><a href="https://bsf.gov.in/page">ab</a>'
    '<a href="https://crpf.gov.in/official">official</a><a href="https://itbp.gov.in/fee-status">Download</a>',
    '<a href="https://bad_host.gov.in/x">Underscore host</a><a href="https://-bad.nic.in/y">Dash label</a>'
    '<a href="https://ok.nic.in/caf\xe9">Non ascii</a>',
    '<img src="/img/ten.jpg">',
    '<p>Age < 30 and marks > 50 count</p><a title="x > y" href="https://ssc.nic.in/go">Go &rsquo;x&rsquo; &#8377;9</a>'
    '<p>India&rsquo;s fee &#8377;100 &hellip; &#x2013; &bogus; &#0; &#xD800; &amp;lt; &notin;</p>',
    '<img src="/static/logo.png"><img src="https://img.example.com/anim.gif">'
    '<img src="data:image/png;base64,AAAA"><img src="/img/a.jpg"><img src="//img.example.com/b.jpg">',
    '<h2>Admit Card released</h2><p>result soon</p>',
    '',
    '<aside>Side text</aside><iframe src="x">frame</iframe><noscript>ns</noscript>'
    '<table><tr><td>Cell A</td><td>Cell B</td></tr></table>\n\n\n\n\n<p>After   blanks</p>',
]
HEAD_SNIPPETS = [
    "", "", "", '<meta name="twitter:image" content="https://img.example.com/tw3.png">', "", "", "", "",
    "", "", '<meta property="og:image" content="https://img.example.com/og10.jpg">',
    '<meta content="https://img.example.com/og11.png" property="og:image">'
    '<meta name="twitter:image" content="https://img.example.com/tw11.png">',
    "", "", "", "",
]
TAIL_SNIPPETS = [""] * 14 + ["<p>The provisional answer key is out.</p>", ""]


def _pick(values: list[str], k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), k + 1)


def pages_ext(pages: DataFrame) -> DataFrame:
    """B1: pages with one test snippet each (same schema as ``pages``)."""
    k = (F.col("page_id") % 16).cast("int")
    html = F.replace(F.col("html"), F.lit("<body>"), F.concat(F.lit("<body>"), _pick(BODY_SNIPPETS, k)))
    html = F.replace(html, F.lit("</head>"), F.concat(_pick(HEAD_SNIPPETS, k), F.lit("</head>")))
    html = F.replace(html, F.lit("</body>"), F.concat(_pick(TAIL_SNIPPETS, k), F.lit("</body>")))
    return pages.select("page_id", "url", html.alias("html"))


# URL variants for the S1 gate, by page_id % 7
def pages_url_variants(pages: DataFrame) -> DataFrame:
    k = (F.col("page_id") % 7).cast("int")
    u = F.col("url")
    no_scheme = F.regexp_replace(u, "^[A-Za-z]+://", "")
    url = (F.when(k == 0, no_scheme)
           .when(k == 1, F.concat(F.lit("  "), u, F.lit(" \n")))
           .when(k == 2, F.lit("   "))
           .when(k == 3, F.concat(F.lit("https://bad_host."), no_scheme))
           .when(k == 4, F.concat(F.lit("//"), no_scheme))
           .when(k == 5, F.concat(u, F.lit("/caf\xe9")))
           .otherwise(u))
    return pages.select("page_id", url.alias("url"), "html")


# ---------------------------------------------------------------- B2 postings_raw
# One row per order; every field is a string as a language model would return it.

POSTING_TYPES = ["job", "admit_card", "result", "answer_key", "syllabus", "blog", "scholarship"]
ORGANIZATIONS = ["SSC", "RRB", "Staff Selection Commission", "Kerala Water Authority",
                 "Delhi University", "NTPC Limited", "Ministry of Defence", "{nation} Public Service Commission", ""]
TITLE_SUFFIXES = ["Recruitment", "Apprentice", "Contract", "Part Time", "Temporary", "Postal"]
SUMMARIES = [
    "Online form started for the posts; apply online before the last date.",
    "Last date extended till next month for all candidates.",
    "Application reopen notice issued; re-registration allowed.",
    "Admit card and hall ticket download link active now.",
    "Final result and merit list published with cut off marks.",
    "Provisional answer key released; objection window open.",
    "Exam date and CBT date schedule announced; exam city intimation soon.",
    "Syllabus and exam pattern PDF available.",
    "Government job vacancies for graduates; sarkari naukri bharti 2025.",
    "Scorecard and marks released for the written test.",
]
CONTENT_EXTRAS = [
    "<h3>Important Links</h3><p>See the table.</p>",
    "<h3>Frequently Asked Questions</h3><p>Q and A here.</p>",
    "<script>var x = 1;</script>",
    "<p>See <a href=\"https://jobs.example.org/jobs\">jobs</a>, <a href=\"https://jobs.example.org/results\">results</a>,"
    " <a href=\"https://jobs.example.org/admit-cards\">admit cards</a>, <a href=\"https://jobs.example.org/syllabus\">syllabus</a>"
    " and <a href=\"https://jobs.example.org/category/ssc\">SSC</a>.</p>",
    "<h3>\U0001F4E2 Stay Updated</h3><p>Follow our channels.</p>",
]
CATEGORY_NAMES = ["State Govt Jobs", "Central Govt Jobs", "Banking", "PSU Jobs", "Teaching Jobs", ""]
TOTAL_POSTS = ["120", "1,234", "-5", "-5 posts", "12.7", "1e3", "As per rules", "", "0"]
SALARIES = ["Pay Level 7 (Rs. 44,900 - 1,42,400)", "Rs. 35,400", "Stipend 9000", ""]
SALARY_TYPES = ["salary", "stipend", "consolidated", "pay_scale", None]
ONLINE_FORMS = ["https://ssc.nic.in/apply?post=1", "https://ssc.nic.in/", "upsc.gov.in/apply/form",
                "https://bad_host.in/x", ""]
APPLY_URLS = ["", "https://ibps.in/register?x=1", "ibps.in", "https://ibps.in/"]
NOTIFICATION_PDFS = ["https://ssc.nic.in/notice.pdf", "", "not a url", "https://SSC.nic.in/Notice.PDF"]
STAGES = ["Written Exam", "Interview", "Document Verification"]
QUALIFICATIONS = [
    "PhD or doctorate in any discipline; MBA or PGDM",
    "LLM or Master of Law; LLB",
    "MBBS degree; M.Tech or M.E. in CSE",
    "M.Pharm; B.Pharm",
    "M.Sc or Master of Science; M.Com",
    "M.A. in English; Chartered Accountant (CA)",
    "Company Secretary (CS); CMA or Cost Accountant",
    "Post Graduate degree; B.Tech or B.E. in ECE",
    "B.Sc in Physics; B.Com",
    "B.A. pass; B.Ed",
    "Nursing (GNM); Graduate in any stream",
    "Diploma in Engineering; ITI certificate",
    "12th pass (10+2) or Intermediate; 10th pass matriculation",
]
LINK_POOL = [
    ("Apply Online", "https://ssc.nic.in/apply"), ("Notification", "https://ssc.nic.in/notice.pdf"),
    ("FJA", "https://www.freejobalert.com/ssc"), ("Apply Online", "https://SSC.nic.in/APPLY"),
    ("", "https://upsc.gov.in/results"), ("Admit Card", ""), ("123", "https://ibps.in/admit"),
    ("Official Website", "ibps.in"), ("Syllabus", "https://rbi.org.in/syllabus.pdf"),
    ("Click here", "https://drdo.gov.in/register"), ("Telegram", "https://t.me/examplejobs"),
    ("WhatsApp", "https://whatsapp.com/channel/example"),
]
META_KEYWORDS = ["", "ssc, jobs, , 2024 ,apply", "a,b,c"]
SOURCE_URLS = ["", "https://www.sarkariresult.com/ssc-cgl", "https://news.example.net/jobs/1"]
DATE_OFFSETS = [("notification_date", 0), ("start_date", 5), ("last_date", 30),
                ("interview_date_from", 45), ("waitlist_date", 60), ("age_as_on_date", -10)]
# how a model may spell a date, by (key + day offset) modulo their number, and the same for SQL
DATE_SPELLINGS = ["yyyy-MM-dd", "d MMMM yyyy", "MMMM d, yyyy", "dd-MMM-yyyy", "yyyy-M-d", "yyyyMMdd", "M/d/yyyy",
                  "dd.MM.yyyy 10:30", "EEEE, d MMM yyyy", "yyyy-MM-dd'T'09:30:00", "dd-MM-yyyy"]
DATE_SPELLINGS_SQL = ["%Y-%m-%d", "%-d %B %Y", "%B %-d, %Y", "%d-%b-%Y", "%Y-%-m-%-d", "%Y%m%d", "%-m/%-d/%Y",
                      "%d.%m.%Y 10:30", "%A, %-d %b %Y", "%Y-%m-%dT09:30:00", "%d-%m-%Y"]
FAQ_EXTRAS = [("", "Answer without a question"), ("Question without an answer?", ""),
              ("<b>Is it free?</b>", "<p>Yes &amp; no</p>")]


def _lits(values):
    return F.array(*[F.lit(v) for v in values])


def _k_pick(values, m_col: Column) -> Column:
    return F.element_at(_lits(values), m_col + 1)


def faq_pairs(conversations: DataFrame) -> DataFrame:
    """User turn = question, the next turn's text = answer when that turn is the assistant's.
    One row per conversation with its ordered FAQ list (a conversation has a few turns by its nature;
    nothing here bounds it)."""
    from pyspark.sql import Window as W
    w = W.partitionBy("conv_id").orderBy("turn")
    pairs = (conversations
             .withColumn("next_role", F.lead("role").over(w))
             .withColumn("next_text", F.lead("text").over(w))
             .filter(F.col("role") == "user")
             .select("conv_id", "turn", F.col("text").alias("question"),
                     F.when(F.col("next_role") == "assistant", F.col("next_text")).otherwise(F.lit(""))
                     .alias("answer")))
    return (pairs.groupBy("conv_id")
                 .agg(F.array_sort(F.collect_list(F.struct("turn", "question", "answer"))).alias("qa"))
                 .select("conv_id", F.transform("qa", lambda x: F.struct(x["question"].alias("question"),
                                                                          x["answer"].alias("answer"))).alias("faq")))


def postings_raw(orders, customer, nation, part, documents, conversations,
                 n_parts: Column, n_docs: Column, n_convs: Column, last: str = "documents") -> DataFrame:
    """B2: one model-shaped posting per order (see FIXTURES.md §B2).

    The joins go from the short columns to the long ones, for what is joined is shuffled with the rows by every join behind
    it: ``last`` is the table whose texts the query reads ("conversations": the FAQ, and only the keys of the documents)."""
    k = F.col("o_orderkey")
    o = orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("od"))
    cust = customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nat = nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    prt = part.select(F.col("p_partkey").alias("_pk"), "p_name")
    docs = documents.select(F.col("doc_id").alias("_dk"), F.col("text").alias("doc_text"))
    faqs = faq_pairs(conversations).withColumnRenamed("conv_id", "_ck")
    df = (o.join(cust, "o_custkey", "left").join(nat, "c_nationkey", "left")
           .withColumn("_pk", k % n_parts).withColumn("_dk", k % n_docs).withColumn("_ck", k % n_convs)
           .join(prt, "_pk", "left"))
    long = [(docs, "_dk"), (faqs, "_ck")] if last == "conversations" else [(faqs, "_ck"), (docs, "_dk")]
    for texts, key in long:
        df = df.join(texts, key, "left")

    def m(n):
        return (k % n).cast("int")

    shifted = F.add_months("od", 336)

    def date_field(offset):
        day = F.date_add(F.when(k % 19 == 0, F.col("od")).otherwise(shifted), offset)
        which = (k + abs(offset)) % len(DATE_SPELLINGS)
        real = F.coalesce(*[F.when(which == i, F.date_format(day, f)) for i, f in enumerate(DATE_SPELLINGS)])
        return (F.when(k % 13 == 0, F.lit("")).when(k % 17 == 0, F.lit("As per notice")).otherwise(real))

    org = F.replace(_k_pick(ORGANIZATIONS, m(9)), F.lit("{nation}"), F.coalesce(F.col("n_name"), F.lit("")))
    year = (F.lit(2020) + k % 7).cast("string")
    title = F.concat_ws(" ", F.col("p_name"), _k_pick(TITLE_SUFFIXES, m(6)), year,
                        F.when(k % 4 == 0, F.concat(F.lit("- "), (k % 500).cast("string"), F.lit(" Posts"))))
    content = F.concat(F.lit("<h3>Overview</h3><p>"), F.coalesce(F.col("doc_text"), F.lit("")), F.lit("</p>"),
                       _k_pick(CONTENT_EXTRAS, m(5)))
    pool = F.array(*[F.struct(F.lit(t).alias("title"), F.lit(u).alias("url")) for t, u in LINK_POOL * 2])
    links = F.slice(pool, m(12) + 1, m(5))
    extra_faq = F.array(*[F.struct(F.lit(qq).alias("question"), F.lit(a).alias("answer")) for qq, a in FAQ_EXTRAS])
    faq = F.concat(F.coalesce(F.col("faq"), F.array().cast("array<struct<question:string,answer:string>>")),
                   F.when(m(7) < 3, F.slice(extra_faq, m(7) + 1, 1))
                   .otherwise(F.array().cast("array<struct<question:string,answer:string>>")))
    state = F.when(m(3) == 0, F.col("n_name")).when(m(3) == 1, F.lit("All India")).otherwise(F.lit(""))

    cols = [
        k.alias("post_id"),
        _k_pick(POSTING_TYPES, m(7)).alias("type"),
        org.alias("organization"),
        title.alias("title"),
        F.when(m(3) == 0, F.col("p_name")).alias("post_name"),
        _k_pick(SUMMARIES, m(10)).alias("short_description"),
        content.alias("content"),
        _k_pick(CATEGORY_NAMES, m(6)).alias("category_name"),
        state.alias("state_name"),
        *[date_field(off).alias(name) for name, off in DATE_OFFSETS],
        F.lit("").alias("end_date"), F.lit("").alias("interview_date_to"),
        F.when(m(2) == 0, F.lit("")).otherwise(F.lit("4:00 PM")).alias("deadline_time"),
        _k_pick(TOTAL_POSTS, m(9)).alias("total_posts"),
        F.when(k % 11 == 0, F.lit("12abc")).otherwise((k % 50).cast("string")).alias("vacancy_gen"),
        (k % 20).cast("string").alias("vacancy_obc"), (k % 10).cast("string").alias("vacancy_sc"),
        (k % 5).cast("string").alias("vacancy_st"), (k % 7).cast("string").alias("vacancy_ews"),
        (k % 3).cast("string").alias("vacancy_ph"),
        F.when(k % 4 == 0, F.lit("0")).otherwise((k % 5 * 100).cast("string")).alias("fee_general"),
        F.when(k % 4 == 0, F.lit("0")).otherwise((k % 5 * 50).cast("string")).alias("fee_obc"),
        F.when(k % 3 == 0, F.lit("0")).otherwise(F.lit("25")).alias("fee_sc_st"),
        F.when(k % 2 == 0, F.lit("0")).otherwise(F.lit("50")).alias("fee_women"),
        F.lit("0").alias("fee_ph"),
        F.when(k % 5 == 0, F.lit("0")).otherwise((18 + k % 3).cast("string")).alias("age_min"),
        F.when(k % 6 == 0, F.lit("")).otherwise((27 + k % 10).cast("string")).alias("age_max_gen"),
        (30 + k % 3).cast("string").alias("age_max_obc"), (32 + k % 3).cast("string").alias("age_max_sc"),
        F.when(k % 4 == 0, F.lit("0")).otherwise((37 + k % 3).cast("string")).alias("age_max_ph"),
        F.lit("0").alias("age_max_ex_serviceman"),
        F.when(k % 3 == 0, F.lit("0")).otherwise((20000 + k % 10 * 1000).cast("string")).alias("salary_min"),
        F.when(k % 3 == 0, F.lit("0")).otherwise((60000 + k % 10 * 1000).cast("string")).alias("salary_max"),
        _k_pick(SALARIES, m(4)).alias("salary"),
        _k_pick(SALARY_TYPES, m(5)).alias("salary_type"),
        _k_pick(ONLINE_FORMS, m(5)).alias("online_form"),
        _k_pick(APPLY_URLS, m(4)).alias("apply_url"),
        _k_pick(NOTIFICATION_PDFS, m(4)).alias("notification_pdf"),
        F.lit("").alias("final_result"),
        F.slice(_lits(STAGES), 1, m(4)).alias("selection_stages"),
        F.when(m(4) == 0, _lits(["graduate", "btech", "xyz_unknown"])).otherwise(F.array().cast("array<string>"))
        .alias("education"),
        F.when(m(4) == 0, _lits(["govt_job", "bogus_tag"])).otherwise(F.array().cast("array<string>")).alias("tags"),
        _k_pick(QUALIFICATIONS, m(13)).alias("qualifications"),
        links.alias("important_links"),
        faq.alias("faq"),
        _k_pick(META_KEYWORDS, m(3)).alias("meta_keywords"),
        F.when(m(5) == 0, F.lit("")).otherwise((k % 18).cast("string")).alias("category_id"),
        F.when(m(4) == 0, F.lit("")).otherwise((k % 32).cast("string")).alias("state_id"),
        _k_pick(SOURCE_URLS, m(3)).alias("source_url"),
        (k % 10 == 0).alias("is_date_extended"),
        F.when(m(8) == 0, F.lit("GATE score used for shortlisting only")).otherwise(F.lit("")).alias("gate_note"),
        F.when(m(2) == 0, F.lit("Typing")).otherwise(F.lit("")).alias("skills"),
        F.lit("").alias("responsibilities"),
        F.lit("").alias("featured_image"),
        F.lit("").alias("meta_title"), F.lit("").alias("meta_description"),
        F.lit(None).cast("string").alias("exam_date"), F.lit(None).cast("string").alias("result_date"),
    ]
    return df.select(*cols)


PREPARED: dict[str, str] = {}  # input folder -> folder with its derived tables, written beforehand


def prepare(spark, sf_dir: str, out: str, files: int = 64) -> None:
    """Writes the derived postings and answers of ``sf_dir`` as many-file tables, which the queries over
    that folder then read instead of deriving them again (the benchmark times operators this way)."""
    load_postings_raw(spark, sf_dir).repartition(files).write.parquet(f"{out}/postings_raw")
    load_responses(spark, sf_dir).repartition(files).write.parquet(f"{out}/responses")
    PREPARED[sf_dir] = out


def row_count(df: DataFrame) -> Column:
    """The number of rows as a scalar subquery: nothing runs until the query does."""
    return df.agg(F.count(F.lit(1))).scalar()


def load_postings_raw(spark, sf_dir: str, last: str = "documents") -> DataFrame:
    from gazette.session import read_table
    if sf_dir in PREPARED:
        return spark.read.parquet(f"{PREPARED[sf_dir]}/postings_raw")
    t = {n: read_table(spark, sf_dir, n) for n in
         ["orders", "customer", "nation", "part", "documents", "conversations"]}
    # few files or row groups would leave the postings to as few tasks, where all joins are broadcast
    t["orders"] = t["orders"].repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    # dense 0..n-1 keys
    n_parts, n_docs = row_count(t["part"]), row_count(t["documents"])
    n_convs = row_count(t["conversations"].select("conv_id").distinct())
    return postings_raw(t["orders"], t["customer"], t["nation"], t["part"], t["documents"],
                        t["conversations"], n_parts, n_docs, n_convs, last)


# ---------------------------------------------------------------- B3 responses
RESPONSE_BODY_FIELDS = ["type", "title", "organization", "short_description", "total_posts", "last_date",
                        "category_name", "state_name", "online_form", "salary", "tags", "education",
                        "important_links", "faq"]
NOT_JSON = "Sorry, I cannot help with that request."


def responses(postings: DataFrame, n_pages: Column) -> DataFrame:
    """One model answer per posting: k % 5 = 0 fenced; 1 cut at 60 %; 2 cut inside the title
    string; 3 cut after a comma past the middle; 4 whole; k % 50 = 49 not JSON, 44 and 39 whole with
    text behind it, 34 whole with two keys given twice."""
    k = F.col("post_id")
    body = F.to_json(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c not in
                                ("tags", "education", "important_links", "faq") else F.col(c)
                                for c in RESPONSE_BODY_FIELDS]))
    df = postings.select("post_id", body.alias("full_body"))
    n = F.length("full_body")
    half = F.floor(n / 2).cast("int")
    rel = F.instr(F.substring(F.col("full_body"), half + 1, n), ",")
    comma = F.when(rel > 0, rel + half).otherwise(F.lit(0))
    m = (k % 5).cast("int")
    cut = (F.when(m == 0, F.concat(F.lit("```json\n"), F.col("full_body"), F.lit("\n```")))
           .when(m == 1, F.substring("full_body", 1, F.floor(n * 3 / 5).cast("int")))
           .when(m == 2, F.substring("full_body", 1, F.locate('"title":"', F.col("full_body")) + 11))
           .when((m == 3) & (comma > 0), F.substring("full_body", 1, comma))
           .otherwise(F.col("full_body")))
    body = (F.when(k % 50 == 49, F.lit(NOT_JSON))
            .when(k % 50 == 44, F.concat(F.col("full_body"), F.lit(" extra")))
            .when(k % 50 == 39, F.concat(F.col("full_body"), F.lit("}")))
            .when(k % 50 == 34, F.concat(F.lit('{"title":"first","total_posts":"7",'), F.substring("full_body", F.lit(2), n)))
            .otherwise(cut))
    return df.select(k.alias("response_id"), (k % n_pages).alias("page_id"), body.alias("body"))


def load_responses(spark, sf_dir: str) -> DataFrame:
    from gazette.session import read_table
    if sf_dir in PREPARED:
        return spark.read.parquet(f"{PREPARED[sf_dir]}/responses")
    n_pages = row_count(read_table(spark, sf_dir, "pages"))
    return responses(load_postings_raw(spark, sf_dir, "conversations"), n_pages)  # an answer holds the FAQ, not the content

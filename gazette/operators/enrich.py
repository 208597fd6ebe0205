"""Enrichment: rule tagging, category correction, dimension lookups.

Rule lists are literal patterns.  Each text that several rules scan is lower-cased once
into a temporary column first, and one scan finds all rules that match it (``found_rules``).
Lookups in the fixed lists are literal maps; a dimension table is joined.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.config import DEFAULT_SITE, SiteConfig
from gazette.functions import rules
from gazette.functions.regex import branch_runs, expand_branch, java, literal, top_level_branches
from gazette.functions.rule_scan import bit, rule_bits
from gazette.functions.text import col, empty_strs, is_blank_str, leading_int, nz, strip_tags
from gazette.sources.dims import unique_dim



def _arr(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _any(conds):
    out = None
    for c in conds:
        out = c if out is None else (out | c)
    return out


def rule_literals(rule_list) -> list[str]:
    """Every literal the prefilters of a rule list test."""
    out = set()
    for _, rx in rule_list:
        for b in top_level_branches(rx):
            exp = expand_branch(b)
            out.update(exp[0] if exp is not None else branch_runs(b))
    return sorted(out)


def trie_regex(words: list[str]) -> str:
    """An alternation of the words that shares their prefixes and tries the longest first."""
    trie: dict = {}
    for w in words:
        node = trie
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def spell(node):
        parts = [(ch if ch.isalnum() or ch == " " else "\\" + ch) + spell(sub) for ch, sub in node.items() if ch]
        if "" in node:
            parts.append("")
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return spell(trie)


def literal_hits(text: Column, words: list[str]) -> Column:
    """The subset of ``words`` occurring in each text (as substrings, overlapping ones included), in one
    regex pass: a lookahead at every position yields the longest word that starts there, and the
    words that are prefixes of it are added."""
    words = sorted(set(words))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({trie_regex(words)}))"), 1))
    shorter = {w: [v for v in words if w.startswith(v)] for w in words}
    more = {w: v for w, v in shorter.items() if len(v) > 1}
    if not more:
        return found
    table = F.from_json(F.lit(json.dumps(more)), "map<string,array<string>>")
    return F.array_distinct(F.flatten(F.transform(found, lambda w: F.coalesce(F.element_at(table, w), F.array(w)))))


def rule_match(text: Column, rx: str, hits: Column) -> Column:
    """``text rlike rx`` for lower-cased text, evaluated branch by branch (a pattern matches
    exactly when one of its top-level branches does):

    * a branch that can only match a few fixed strings -> substring tests;
    * any other branch -> its regex, run only when the text holds every literal run that each
      match of the branch must contain.

    Substring tests read ``hits`` (the literals present, from ``literal_hits``)."""
    parts = []
    for b in top_level_branches(rx):
        exp = expand_branch(b)
        if exp is not None and not exp[1]:
            parts.append(_any([F.array_contains(hits, s) for s in exp[0]]))
            continue
        m = text.rlike(java(b))
        if exp is not None:
            pre = _any([F.array_contains(hits, s) for s in exp[0]])
        else:
            pre = None
            for r in branch_runs(b):
                c = F.array_contains(hits, r)
                pre = c if pre is None else (pre & c)
        parts.append(F.when(pre, m).otherwise(F.lit(False)) if pre is not None else m)
    return _any(parts)


def _codes(text: Column, rule_list, hits: Column | None, also: Column | None = None, found: Column | None = None) -> Column:
    """Codes whose pattern matches ``text`` (already lower-cased) or that ``also`` holds, in rule order; the matches are
    read from ``found`` (``found_rules``), or made from the literals ``hits``."""
    def holds(code, rx):
        here = rule_match(text, rx, hits) if found is None else bit(found, SCANNED.index(rx))
        return here if also is None else F.array_contains(also, code) | here

    return F.array_compact(F.array(*[F.when(holds(code, rx), F.lit(code)) for code, rx in rule_list]))


DEGREE_PREFILTER = r"bachelor|graduat|degree"
# every pattern that E1-E4 hold against a lower-cased text, once each; its place is its bit in ``found_rules``
SCANNED = list(dict.fromkeys([rx for _, rx in rules.EDUCATION_RULES + rules.TAG_RULES + rules.SIGNAL_RULES]
                             + [rules.EDUCATION_DEGREE_WORDS]))


def found_rules(text: Column) -> Column:
    """The rules (``SCANNED``) that match each lower-cased text, as bits: one scan serves E1, E2 and E3."""
    return rule_bits(text, SCANNED)


def _degree(text: Column, lowered: Column, hits: Column | None, found: Column | None) -> Column:
    """Whether ``text``, in any case, names a degree.  The scan has read it lower-cased, which turns two characters beyond
    ASCII into letters; a text with one of those is read as it is."""
    plain = text.rlike(java(rules.EDUCATION_DEGREE_WORDS, ci=True))
    if found is None:
        return F.when(rule_match(lowered, DEGREE_PREFILTER, hits), plain).otherwise(F.lit(False))
    odd = text.contains("\u0130") | text.contains("\u212a")
    return F.when(odd, plain).otherwise(bit(found, SCANNED.index(rules.EDUCATION_DEGREE_WORDS)))


def detection_literals() -> list[str]:
    """All literals the education and tag rules test (one pass serves both)."""
    return sorted(set(rule_literals(rules.EDUCATION_RULES + [("", DEGREE_PREFILTER)]))
                  | set(rule_literals(rules.TAG_RULES)))


# ---------------------------------------------------------------- E1-E3 over a text in parts

SEAM = 64  # characters; every rule matches fewer, and looks at most one character beyond its match
MATCHES = "education array<string>, tags array<string>, signals array<string>, degree boolean, head string"


def _cut_mark(char: Column) -> Column:
    """A character of the same kind, so that a cut beside ``char`` is no word boundary."""
    return F.when(char.rlike("[A-Za-z0-9_]"), F.lit("_")).otherwise(F.lit(" "))


def head(text: Column) -> Column:
    """The start of a text, as far as a match over a seam before it can reach, and a mark where it is cut."""
    start = F.substring(text, 1, SEAM)
    return F.when(F.char_length(text) > SEAM, F.concat(start, _cut_mark(F.substring(start, -1, 1)))).otherwise(text)


def tail(text: Column) -> Column:
    """The end of a text, as far as a match over a seam behind it can reach, and a mark where it is cut."""
    end = F.substring(text, -SEAM, SEAM)
    return F.when(F.char_length(text) > SEAM, F.concat(_cut_mark(F.substring(end, 1, 1)), end)).otherwise(text)


def all_literals() -> list[str]:
    return sorted(set(detection_literals()) | set(rule_literals(rules.SIGNAL_RULES)))


def match_summary(df: DataFrame, text: str, out: str = "matches") -> DataFrame:
    """``out``: all that E1, E2 and E3 need of a text which follows another text and a blank: the codes it matches by
    itself, and its lower-cased head for the matches over the seam.  A null text counts as empty."""
    df = df.withColumn("_lt", F.lower(nz(text)))
    df = df.withColumn("_found", found_rules(F.col("_lt")))
    low, f = F.col("_lt"), F.col("_found")
    return df.withColumn(out, F.struct(
        _codes(low, rules.EDUCATION_RULES, None, found=f).alias("education"), _codes(low, rules.TAG_RULES, None, found=f).alias("tags"),
        _codes(low, rules.SIGNAL_RULES, None, found=f).alias("signals"),
        F.coalesce(_degree(nz(text), low, None, f), F.lit(False)).alias("degree"), head(low).alias("head"))).drop("_lt", "_found")


# ---------------------------------------------------------------- E1

def detect_education(df: DataFrame, text: str, current: str = "education", out: str = "education",
                     lowered: str | None = None, hits: str | None = None, rest: str | None = None,
                     found: str | None = None) -> DataFrame:
    """Keep a non-empty current list; else the 26 ordered rules, post_graduate added for any
    master's, graduate for any bachelor's or degree word, graduate dropped for master's only;
    default ['graduate'].  ``rest`` names the summary of a text that follows ``text``; ``lowered``, ``hits``
    and ``found`` (``found_rules``) then include its head."""
    cur = F.coalesce(F.col(current), empty_strs())
    df = df.withColumn("_need", F.size(cur) == 0)
    low = F.col(lowered) if lowered else F.lower(nz(text))
    df = df.withColumn("_lt", F.when(F.col("_need"), low))
    if hits is None and found is None:
        df, found = df.withColumn("_found", found_rules(F.col("_lt"))), "_found"
    h, f = hits and F.col(hits), found and F.col(found)
    det = _codes(F.col("_lt"), rules.EDUCATION_RULES, h, F.col(rest)["education"] if rest else None, f)
    df = df.withColumn("_det", F.when(F.col("_need"), det))
    d = F.col("_det")
    masters = F.arrays_overlap(d, _arr(rules.EDUCATION_MASTERS))
    degree = _degree(nz(text), F.col("_lt"), h, f)
    degree = degree | F.col(rest)["degree"] if rest else degree
    bachelors = F.arrays_overlap(d, _arr(rules.EDUCATION_BACHELORS)) | degree
    df = df.withColumn("_m", F.when(F.col("_need"), masters)).withColumn("_b", F.when(F.col("_need"), bachelors))
    d = F.when(F.col("_m") & ~F.array_contains(d, "post_graduate"),
               F.concat(d, F.array(F.lit("post_graduate")))).otherwise(d)
    d = F.when(F.col("_b") & ~F.array_contains(d, "graduate"), F.concat(d, F.array(F.lit("graduate")))).otherwise(d)
    d = F.when(F.col("_m") & ~F.col("_b"), F.array_remove(d, "graduate")).otherwise(d)
    d = F.array_distinct(d)
    d = F.when(F.size(d) == 0, F.array(F.lit(rules.EDUCATION_DEFAULT))).otherwise(d)
    out_df = df.withColumn(out, F.when(~F.col("_need"), cur).otherwise(d))
    return out_df.drop("_lt", "_det", "_m", "_b", "_need", *(["_found"] if found == "_found" else []))


# ---------------------------------------------------------------- E2 .. E4

def detect_tags(df: DataFrame, text: str, current: str = "tags", out: str = "tags",
                lowered: str | None = None, hits: str | None = None, rest: str | None = None, found: str | None = None) -> DataFrame:
    """Current string tags, then the 18 rule tags in order, ordered-distinct (``rest``, ``found``: see E1)."""
    df = df.withColumn("_lt", F.col(lowered) if lowered else F.lower(nz(text)))
    if hits is None and found is None:
        df, found = df.withColumn("_tfound", found_rules(F.col("_lt"))), "_tfound"
    cur = F.filter(F.coalesce(F.col(current), empty_strs()), lambda x: x.isNotNull())
    det = _codes(F.col("_lt"), rules.TAG_RULES, hits and F.col(hits), F.col(rest)["tags"] if rest else None, found and F.col(found))
    return df.withColumn(out, F.array_distinct(F.concat(cur, det))).drop("_lt", *(["_tfound"] if found == "_tfound" else []))


def apply_update_signals(df: DataFrame, source_text: str) -> DataFrame:
    """Headline signals over title + summary + content + source add tags (the first also sets
    is_date_extended), then one tag for the type; jobs add govt_job and, with posts, new_vacancy."""
    combined = F.lower(F.btrim(F.concat_ws(" ", nz("title"), nz("short_description"), nz("content"),
                                           nz(source_text)), F.lit(" \t\n\r\x00\x0b")))
    df = df.withColumn("_lt", combined)
    df = df.withColumn("_found", found_rules(F.col("_lt")))
    df = df.withColumn("_sig", _codes(F.col("_lt"), rules.SIGNAL_RULES, None, found=F.col("_found")))
    return _with_signals(df).drop("_lt", "_found", "_sig")


def apply_update_signals_in_parts(df: DataFrame, lowered: str, rest: str, hits: str | None = None, found: str | None = None) -> DataFrame:
    """E3 where the source text starts with the row's own content: ``lowered`` is that text with the head of what
    follows, ``hits`` its literals or ``found`` its rules, and ``rest`` the summary of what follows.  Title and summary are read once more with the seams
    around the content; blank lines keep the two apart, and no rule matches over those."""
    title = F.lower(F.concat_ws(" ", nz("title"), nz("short_description")))
    content, own, n = F.lower(nz("content")), F.col(lowered), SEAM + 1
    before = F.concat_ws(" ", title, head(F.concat_ws(" ", F.substring(content, 1, n), F.substring(own, 1, n))))
    last = lambda c: F.when(F.char_length(c) > n, F.substring(c, -n, n)).otherwise(c)
    behind = F.concat_ws(" ", tail(F.concat_ws(" ", last(title), last(content))), head(own))
    df = df.withColumn("_lt", F.concat_ws("\n\n", before, behind))
    df = df.withColumn("_seams", literal_hits(F.col("_lt"), rule_literals(rules.SIGNAL_RULES)))  # a few hundred characters
    df = df.withColumn("_known", F.array_union(_codes(F.col("_lt"), rules.SIGNAL_RULES, F.col("_seams")), F.col(rest)["signals"]))
    df = df.withColumn("_sig", _codes(own, rules.SIGNAL_RULES, hits and F.col(hits), F.col("_known"), found and F.col(found)))
    return _with_signals(df).drop("_lt", "_seams", "_known", "_sig")


def _with_signals(df: DataFrame) -> DataFrame:
    """The tags and the flag that the signals ``_sig`` and the type give."""
    typ = nz("type")
    type_tags = (F.when(typ == "admit_card", F.array(F.lit("admit_card")))
                 .when(typ == "answer_key", F.array(F.lit("answer_key")))
                 .when(typ == "syllabus", F.array(F.lit("syllabus")))
                 .when(typ == "result", F.array(F.lit("final_result")))
                 .when(typ == "job", F.when(leading_int(F.col("total_posts").cast("string")) > 0,
                                            _arr(["govt_job", "new_vacancy"])).otherwise(_arr(["govt_job"])))
                 .otherwise(empty_strs()))
    cur = F.coalesce(F.col("tags"), empty_strs())
    ext = F.array_contains("_sig", rules.SIGNAL_RULES[0][0])
    return (df.withColumn("tags", F.array_distinct(F.concat(cur, F.col("_sig"), type_tags)))
              .withColumn("is_date_extended", ext | F.coalesce(F.col("is_date_extended").cast("boolean"), F.lit(False))))


def default_tags(df: DataFrame, lowered_src: str | None = None, hits: str | None = None, found: str | None = None) -> DataFrame:
    """Blank tags at publish -> type defaults + E2 over title + summary + stripped content
    (``lowered_src``: that text already lower-cased, when the caller has it)."""
    blank = F.size(F.coalesce(F.col("tags"), empty_strs())) == 0
    if lowered_src:
        df = df.withColumn("_src", F.when(blank, F.col(lowered_src)))
    else:
        src = F.concat(nz("title"), F.lit(" "), nz("short_description"), F.lit(" "), strip_tags(nz("content")))
        df = df.withColumn("_src", F.when(blank, F.lower(src)))
    df = df.withColumn("_none", empty_strs())
    df = detect_tags(df, "_src", current="_none", out="_det", lowered="_src", hits=hits, found=found)
    typ = F.coalesce(F.col("type"), F.lit("job"))
    dflt = _arr(rules.DEFAULT_TAGS_OTHER)
    for t, tags in reversed(rules.DEFAULT_TAGS_BY_TYPE):
        dflt = F.when(typ == t, _arr(tags)).otherwise(dflt)
    filled = F.array_distinct(F.concat(dflt, F.col("_det")))
    cur = F.coalesce(F.col("tags"), empty_strs())
    return df.withColumn("tags", F.when(F.size(cur) == 0, filled).otherwise(cur)).drop("_src", "_none", "_det")


# ---------------------------------------------------------------- E5 .. E8

def _any_contains(text: Column, words) -> Column:
    cond = None
    for w in words:
        c = text.contains(w)
        cond = c if cond is None else (cond | c)
    return cond


def correct_category(df: DataFrame, whole_word: bool = False) -> DataFrame:
    """E5: any PSU word in organisation + title + summary -> PSU category, All India; else a state
    category with a central-government word -> central category, All India.  Words are substrings
    (as the source does); ``whole_word=True`` requires word boundaries instead."""
    df = df.withColumn("_lt", F.lower(F.concat_ws(" ", nz("organization"), nz("title"), nz("short_description"))))
    t = F.col("_lt")
    if whole_word:
        psu = t.rlike(java("|".join(r"\b" + literal(w) + r"\b" for w in rules.PSU_WORDS)))
    else:
        psu = _any_contains(t, rules.PSU_WORDS)
    central = (F.col("category_name") == rules.STATE_CATEGORY) & _any_contains(t, rules.CENTRAL_WORDS)
    df = df.withColumn("_psu", psu).withColumn("_central", ~F.col("_psu") & central)
    return (df.withColumn("category_name", F.when(F.col("_psu"), F.lit(rules.PSU_CATEGORY))
                          .when(F.col("_central"), F.lit(rules.CENTRAL_CATEGORY)).otherwise(F.col("category_name")))
              .withColumn("state_name", F.when(F.col("_psu") | F.col("_central"), F.lit(rules.ALL_INDIA))
                          .otherwise(F.col("state_name")))
              .drop("_lt", "_psu", "_central"))


def category_id_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in rules.CATEGORY_IDS for x in kv])


def resolve_category_id(df: DataFrame, dim_category: DataFrame | None = None,
                        prefer_name: bool = True) -> DataFrame:
    """A blank id comes from the name through the alias dimension (else 14); with
    ``prefer_name`` (the step after category correction) a name found in the dimension wins.

    With ``dim_category`` (name, category_id) the lookup is a left join on the name; of a name that
    occurs twice the smallest id counts."""
    df = _with_category(df, "category_name", dim_category)
    cid = F.col("category_id").cast("string")
    base = (F.when(~is_blank_str(cid), leading_int(cid))
            .when(~is_blank_str("category_name"), F.coalesce(F.col("_dim_id"), F.lit(rules.CATEGORY_DEFAULT_ID)))
            .otherwise(F.lit(rules.CATEGORY_DEFAULT_ID)).cast("long"))
    out = F.coalesce(F.col("_dim_id"), base) if prefer_name else base
    return df.withColumn("category_id", out).drop("_dim_id")


def _with_category(df: DataFrame, name: str, dim_category: DataFrame | None) -> DataFrame:
    """``_dim_id``: the id of the category called ``name`` (null when the dimension has none)."""
    if dim_category is None:
        return df.withColumn("_dim_id", F.element_at(category_id_map(), F.col(name)).cast("long"))
    dim = unique_dim(dim_category.select(F.col("name").alias("_dim_name"),
                                         F.col("category_id").cast("long").alias("_dim_id")), "_dim_name")
    return df.join(dim, F.col(name) == F.col("_dim_name"), "left").drop("_dim_name")


def override_category_by_type(df: DataFrame, dim_category: DataFrame | None = None) -> DataFrame:
    """Six non-job types force the category name; the id changes only when the dimension knows
    the name (the alias list knows none of the six), else a warning is recorded."""
    m = F.create_map(*[F.lit(x) for kv in rules.TYPE_CATEGORY for x in kv])
    forced = F.element_at(m, F.coalesce(F.col("type"), F.lit("job")))
    df = _with_category(df.withColumn("_forced", forced), "_forced", dim_category).withColumnRenamed("_dim_id", "_known")
    return (df.withColumn("category_name", F.coalesce(F.col("_forced"), F.col("category_name")))
              .withColumn("category_id", F.coalesce(F.col("_known"), F.col("category_id")))
              .withColumn("category_warning", F.when(F.col("_forced").isNotNull() & F.col("_known").isNull(),
                                                     F.concat(F.lit("category not in dimension: "), F.col("_forced"))))
              .drop("_forced", "_known"))


def dim_literal(entries: list[tuple[int, str]]) -> Column:
    """A small dimension (ordinal, id, name) as a literal array of structs."""
    return F.array(*[F.struct(F.lit(i + 1).alias("ordinal"), F.lit(str(id_)).alias("id"),
                              F.lit(name.lower().strip()).alias("lname"))
                     for i, (id_, name) in enumerate(entries)])


def match_dim_by_name(df: DataFrame, name: str, entries: list[tuple[int, str]], prefix: str) -> DataFrame:
    """Exact case-insensitive match first; else the best score over the dimension
    (length of a contained candidate, length of the name inside a candidate, 5 x shared words),
    earliest candidate on ties, no match at score 0.

    The dimension is a fixed literal list evaluated per row with higher-order functions:
    no join and no pairs leave the row (``name_match.match_dim_table`` takes a live table)."""
    cands = dim_literal(entries)
    df = df.withColumn("_q", F.lower(F.trim(nz(name)))).withColumn("_qw", F.split(F.col("_q"), r"\s+"))
    q, qw = F.col("_q"), F.col("_qw")
    exact = F.get(F.filter(cands, lambda c: c["lname"] == q), 0)

    def score(c):
        contained = F.when(F.instr(q, c["lname"]) > 0, F.length(c["lname"])).otherwise(F.lit(0))
        contains = F.when(F.instr(c["lname"], q) > 0, F.length(q)).otherwise(F.lit(0))
        shared = F.size(F.filter(qw, lambda w: F.array_contains(F.split(c["lname"], r"\s+"), w)))
        s = F.greatest(contained, contains, F.when(shared > 0, shared * 5).otherwise(F.lit(0)))
        return F.struct(s.alias("score"), (-c["ordinal"]).alias("neg_ord"), c["id"].alias("id"))

    best = F.array_max(F.filter(F.transform(cands, score), lambda s: s["score"] > 0))
    df = df.withColumn("_exact", exact).withColumn("_best", F.when(q == "", F.lit(None)).otherwise(best))
    df = df.withColumn("_exact", F.when(q == "", F.lit(None)).otherwise(F.col("_exact")))
    return (df.withColumn(f"{prefix}_id", F.coalesce(F.col("_exact.id"), F.col("_best.id")))
              .withColumn(f"{prefix}_match", F.when(F.col("_exact").isNotNull(), F.lit("exact"))
                          .when(F.col("_best").isNotNull(), F.lit("fuzzy")))
              .withColumn(f"{prefix}_score", F.when(F.col("_exact").isNotNull(), F.lit(None).cast("int"))
                          .otherwise(F.col("_best.score")))
              .drop("_q", "_qw", "_exact", "_best"))


# ---------------------------------------------------------------- E9 .. E11

def credential_levels(education) -> Column:
    """Education codes -> credential levels, unknown dropped, distinct in order."""
    m = F.create_map(*[F.lit(x) for kv in rules.CREDENTIAL_LEVELS for x in kv])
    return F.array_distinct(F.array_compact(F.transform(F.coalesce(col(education), empty_strs()),
                                                        lambda e: F.element_at(m, e))))


def required_link_target(content, site: SiteConfig = DEFAULT_SITE, minimum: int = 5) -> tuple[Column, Column]:
    """Number of anchors to the site in the content, and whether it reaches the minimum."""
    rx = java(r"""<a[^>]+href=["']https?://(?:www\.)?""" + literal(site.host) + r"""(?:[/?#][^"']*)?["']""", ci=True)
    n = F.size(F.regexp_extract_all(nz(content), F.lit(rx), 0))
    return n, n >= minimum


EXAM_TYPES = ["admit_card", "result", "answer_key", "syllabus"]
ZERO_NUMBERS = ["total_posts", "salary_min", "salary_max", "age_min", "age_max_gen", "fee_general", "fee_obc",
                "fee_sc_st", "fee_women", "fee_ph"]


def type_zero_fields(df: DataFrame) -> Column:
    """Fields that must be zero/blank for the posting type but are not (as one list)."""
    typ = F.coalesce(F.col("type"), F.lit("job"))
    checks = []
    for f in ZERO_NUMBERS:
        nonzero = leading_int(F.col(f).cast("string")) != 0
        applies = typ.isin(*EXAM_TYPES, "blog") | ((typ == "scholarship") & F.lit(f == "total_posts"))
        checks.append(F.when(applies & nonzero, F.lit(f)))
    checks.append(F.when(typ.isin(*EXAM_TYPES, "blog") & (F.size(F.coalesce("education", empty_strs())) > 0),
                         F.lit("education")))
    for f in ("qualifications", "skills", "responsibilities"):
        checks.append(F.when(typ.isin(*EXAM_TYPES) & ~is_blank_str(f), F.lit(f)))
    return F.array_compact(F.array(*checks))

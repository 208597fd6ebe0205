"""The two regex dialects agree with the source's byte-oriented PCRE semantics."""
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gazette.functions import rules
from gazette.functions.regex import branch_runs, expand_branch, java, top_level_branches
from gazette.operators.enrich import literal_hits, rule_literals, rule_match

SAMPLES = [
    "phd in physics", "ph.d holder", "mba/pgdm", "llb and llm", "m.tech or m.e. in cse", "b.e. pass",
    "ca final", "icai ca", "cs executive", "cma inter", "post graduate", "m.sc", "msc.", "b.a. hons",
    "mca", "b.ed", "gnm nursing", "graduate in any", "graduation", "diploma", "iti pass", "12th pass",
    "hsc", "10+2", "10th", "ssc exam", "matriculation", "secondary school", "été t été", "cut-off marks",
    "cutoff", "merit list", "final result", "marks released", "admit card", "exam date", "answer key",
    "syllabus", "recruitment", "vacancies", "govt. job", "sarkari naukri", "link active", "registration started",
    "last date extended", "re-open", "café ca", "x\nca\ny", "ca_b", "_ca", "ca1", "a.ca.b",
]


def test_java_dialect_matches_ascii_pcre(spark):
    pats = [rx for _, rx in rules.EDUCATION_RULES + rules.TAG_RULES + rules.SIGNAL_RULES]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, t string")
    got = df.orderBy("i").select(*[F.col("t").rlike(java(p)).alias(f"p{j}") for j, p in enumerate(pats)]).collect()
    for i, s in enumerate(SAMPLES):
        for j, p in enumerate(pats):
            want = re.search(p, s, re.ASCII) is not None
            assert got[i][j] == want, (s, p)


def test_rule_match_equals_plain_regex(spark):
    pats = [rx for _, rx in rules.EDUCATION_RULES + rules.TAG_RULES]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, t string")
    df = df.withColumn("h", literal_hits(F.col("t"), rule_literals(rules.EDUCATION_RULES + rules.TAG_RULES)))
    got = df.orderBy("i").select(*[rule_match(F.col("t"), p, F.col("h")).alias(f"p{j}") for j, p in enumerate(pats)]).collect()
    for i, s in enumerate(SAMPLES):
        for j, p in enumerate(pats):
            assert got[i][j] == (re.search(p, s, re.ASCII) is not None), (s, p)


ALPHABET = st.sampled_from(list("abcdegmnoprstuhiy.-+ 012\n"))


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=40))
def test_prefilters_are_necessary(text):
    """Whenever a branch matches, every literal its prefilter requires is in the text."""
    for _, rx in rules.EDUCATION_RULES + rules.TAG_RULES:
        for b in top_level_branches(rx):
            if re.search(b, text, re.ASCII) is None:
                continue
            exp = expand_branch(b)
            if exp is not None:
                assert any(s in text for s in exp[0]), (b, text)
            else:
                assert all(r in text for r in branch_runs(b)), (b, text)

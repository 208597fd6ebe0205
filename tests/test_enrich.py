"""Rule tagging and category correction, including the documented quirks."""
from pyspark.sql import functions as F

from gazette.operators import enrich as E
from gazette.operators import normalize as N
from gazette.functions import rules


def _edu(spark, texts, current=None):
    df = spark.createDataFrame([(i, t, current or []) for i, t in enumerate(texts)],
                               "i int, t string, education array<string>")
    return [r.education for r in E.detect_education(df, "t").orderBy("i").select("education").collect()]


def test_education_rules(spark):
    got = _edu(spark, ["Candidates with MBA or PGDM", "HSC passed", "M.Sc physics only",
                       "B.Tech and a degree", "nothing relevant", "hsc in hscore"])
    assert got[0] == ["mba", "post_graduate"]
    assert got[1] == ["12th_pass"]                                 # D4: hsc
    assert got[2] == ["msc", "post_graduate"]                      # master's only: no graduate
    assert got[3] == ["btech", "graduate"]
    assert got[4] == ["graduate"]                                  # default
    assert got[5] == ["12th_pass"]


def test_education_kept_when_present(spark):
    assert _edu(spark, ["PhD"], current=["iti"]) == [["iti"]]


def test_tags_and_signals(spark):
    df = spark.createDataFrame([("Last date extended; cut-off and merit list out", "job", "120", ["x"]),
                                ("Admit card link active", "admit_card", "0", [])],
                               "t string, type string, total_posts string, tags array<string>")
    got = [r.tags for r in E.detect_tags(df, "t").collect()]
    assert got[0] == ["x", "cutoff", "merit_list", "date_extended"]
    assert got[1] == ["admit_card", "link_working"]
    df2 = df.withColumn("title", F.lit("")).withColumn("short_description", F.col("t")).withColumn(
        "content", F.lit("")).withColumn("is_date_extended", F.lit(None).cast("boolean"))
    out = E.apply_update_signals(df2, "content").select("tags", "is_date_extended").collect()
    assert out[0].tags == ["x", "date_extended", "govt_job", "new_vacancy"] and out[0].is_date_extended
    assert out[1].tags == ["link_working", "admit_card"] and not out[1].is_date_extended


def test_correct_category(spark):
    df = spark.createDataFrame([("Shall Recruit", "Clerk", "", "State Govt Jobs", "Kerala"),
                                ("Ministry of Defence", "Clerk", "", "State Govt Jobs", "Kerala"),
                                ("Kerala PSC", "Clerk", "", "State Govt Jobs", "Kerala")],
                               "organization string, title string, short_description string, "
                               "category_name string, state_name string")
    got = [tuple(r) for r in E.correct_category(df).select("category_name", "state_name").collect()]
    assert got[0] == ("PSU Jobs", "All India")          # D3: 'hal' inside 'shall'
    assert got[1] == ("Central Govt Jobs", "All India")
    assert got[2] == ("State Govt Jobs", "Kerala")
    got_ww = [r.category_name for r in E.correct_category(df, whole_word=True).collect()]
    assert got_ww[0] == "State Govt Jobs"


def test_match_dim_by_name(spark):
    df = spark.createDataFrame([("all india",), ("INDIA",), ("Tamil",), ("", ), ("Nowhere",)], "n string")
    got = [tuple(r) for r in E.match_dim_by_name(df, "n", rules.FALLBACK_STATES, "s").select(
        "s_id", "s_match", "s_score").collect()]
    assert got == [("0", "exact", None), ("0", "fuzzy", 5), ("23", "fuzzy", 5), (None, None, None),
                   (None, None, None)]


def test_slug(spark):
    df = spark.createDataFrame([("Staff Selection Commission Delhi", "SSC CGL Recruitment 2025 Apply Now", "", "120"),
                                ("", "Junior Clerk Post", "", "0")],
                               "organization string, title string, short_description string, total_posts string")
    got = [r.slug for r in N.derive_slug(df).collect()]
    assert got[0] == "staff-selection-commission-ssc-cgl-2025-now-recruitment-2025-120-posts"
    assert got[1] == "govt-junior-clerk-recruitment-2026"
    import re
    assert all(re.fullmatch(r"[a-z0-9-]{1,70}", s) for s in got)

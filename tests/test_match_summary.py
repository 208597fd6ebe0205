"""E1-E3 over a text in parts: the rows of the whole text, with matches over every seam."""
import random
import re

from pyspark.sql import functions as F

from gazette.functions import rules
from gazette.functions.text import nz
from gazette.operators import enrich as E

PATTERNS = [rx for part in (rules.EDUCATION_RULES, rules.TAG_RULES, rules.SIGNAL_RULES) for _, rx in part] + [rules.EDUCATION_DEGREE_WORDS]
WORDS = """post graduate diploma manage master of law bachelor degree M.Tech m.e. B.Sc ph.d mba xmba mbax last date extended extended till
exam city re open online form start apply-online started link active cut off cut-off higher secondary 10+2 10 th hsc download govt. job
marks released advt notification industrial training institute call letter Graduate graduates answer key \u0130 \u03a3 _ iti""".split()


def test_no_rule_matches_more_than_a_seam():
    assert max(re._parser.parse(rx).getwidth()[1] for rx in PATTERNS) < E.SEAM
    assert not any("\\n" in rx or "\\s\\s" in rx or "(?s" in rx for rx in PATTERNS)  # none crosses a blank line


def _whole(df):
    df = df.withColumn("_src", F.concat_ws(" ", nz("content"), nz("qualifications"), nz("raw")))
    return E.apply_update_signals(E.detect_tags(E.detect_education(df, "_src"), "_src"), "_src")


def _parts(df):
    df = E.match_summary(df, "raw", "m")
    df = df.withColumn("_src", F.concat_ws(" ", nz("content"), nz("qualifications")))
    df = df.withColumn("_low", F.concat_ws(" ", F.lower("_src"), F.col("m.head")))
    df = df.withColumn("_h", E.literal_hits(F.col("_low"), E.all_literals()))
    part = {"lowered": "_low", "hits": "_h", "rest": "m"}
    return E.apply_update_signals_in_parts(E.detect_tags(E.detect_education(df, "_src", **part), "_src", **part), **part)


def test_parts_equal_the_whole(spark):
    rng = random.Random(5)

    def text():
        kind = rng.random()
        if kind < 0.1:
            return None
        if kind < 0.2:
            return rng.choice(["", " ", "\n", "post", "x", "date", "last date"])
        words = [rng.choice(WORDS) for _ in range(rng.choice([1, 2, 3, 12, 40]))]
        filler = "".join(rng.choice("ab ") for _ in range(rng.choice([0, 0, 55, 60, 64, 65, 70, 200])))
        out = rng.choice([" ", " ", "", "-"]).join(words)
        return rng.choice([out, filler + out, out + filler, filler])

    rows = [(i, text(), text(), text(), text(), text(), rng.choice(["job", "result"]), "12", [], ["phd"] if i % 9 == 0 else [], None)
            for i in range(4000)]
    # planted: every way of cutting these in two or more parts
    for phrase in ("post graduate diploma manage", "last date extended", "higher secondary school", "deadline extended till"):
        words = phrase.split(" ")
        for at in range(1, len(words)):
            a, b = " ".join(words[:at]), " ".join(words[at:])
            for k in range(4):
                cells = ["", "", "", "", ""]
                cells[k], cells[k + 1] = "lorem " * 20 + a, b + " ipsum" * 20
                rows.append((len(rows), *cells, "job", "0", [], [], None))
    df = spark.createDataFrame(rows, "i int, title string, short_description string, content string, qualifications string, raw string, "
                                     "type string, total_posts string, tags array<string>, education array<string>, is_date_extended boolean")
    cols = ["i", "education", "tags", "is_date_extended"]
    want, got = ({r["i"]: r for r in made(df).select(cols).collect()} for made in (_whole, _parts))
    assert [(want[i], got[i]) for i in want if want[i] != got[i]] == [] and len(want) == len(rows)
    assert sum(r["is_date_extended"] for r in want.values()) > 50


def test_page_text_stays_behind_the_join(spark):
    from gazette.plans.enrich import page_side
    facts = spark.createDataFrame([(1, "u", "secret " * 50, None, None, "job")],
                                  "page_id long, url string, text string, official_links array<string>, featured_image string, detected_type string")
    assert "secret" in page_side(facts).first()["page_matches"]["head"]
    assert len(page_side(facts).first()["page_matches"]["head"]) == E.SEAM + 1 and "text" not in page_side(facts).columns

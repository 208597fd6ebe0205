"""One scan finds the rules that every pattern by itself finds."""
import random
import re
import time

from helpers import one_col
from pyspark.sql import functions as F

from gazette.functions.rule_scan import REACH, ROUNDS, WINDOW
from gazette.operators import enrich as E

WORDS = """post graduate diploma manage master of law bachelor degree m.tech m.e. b.sc ph.d mba xmba mbax last date extended till exam city re
open online form start started link active cut off cut-off higher secondary 10+2 10 th hsc govt. govt job marks released ca cs cma _ca ca_ iti é ü€ 😀""".split()


def wanted(text):
    return sum(1 << i for i, rx in enumerate(E.SCANNED) if text is not None and re.search(rx, text, re.ASCII))


def test_scan_equals_the_plain_patterns(spark):
    rng = random.Random(3)
    texts = [None, "", "ca", " ca", "xca", "caé", "éca", "\nca\n", "govt\njob", "a" * 5000]
    for _ in range(3000):
        parts = []
        for _ in range(rng.choice([1, 2, 5, 40])):
            parts.append(rng.choice([" ", " ", "", ".", "-", "\n"]).join(rng.choices(WORDS, k=rng.randint(1, 5))))
            parts.append("".join(rng.choices(["x", "é", " ", "_", "😀"], k=rng.choice([0, 1, WINDOW - 30, WINDOW, REACH, WINDOW + REACH + rng.randint(-6, 6)]))))
        texts.append(rng.choice(["", " "]).join(parts))
    assert [t for t, g in zip(texts, one_col(spark, texts, E.found_rules)) if g != wanted(t)] == []


def test_a_match_at_every_cut(spark):
    """A rule at each place around the ends of the windows, after more places than are searched for one by one."""
    texts = ["mba " * k + "y" * n + end for k in (1, ROUNDS * (WINDOW // 4)) for n in range(WINDOW + REACH + 8) for end in ("ca", "xca", " cax", " ca")]
    assert one_col(spark, texts, E.found_rules) == [wanted(t) for t in texts]


def test_time_grows_with_the_text(spark):
    def seconds(n):
        df = spark.createDataFrame([(("ca " + "x " * 150) * n,)], "t string").select(E.found_rules(F.col("t")))
        df.collect()
        start = time.perf_counter()
        df.collect()
        return time.perf_counter() - start
    assert seconds(40_000) < 8 * max(seconds(10_000), 0.25)


def test_no_literals_are_collected_for_e1_to_e4(spark):
    """The scan in place of a match at every character: it was most of the time of E1-E4."""
    df = spark.createDataFrame([("t", "s", "mba ca", "src", "job", "1", [], [], False)], "title string, short_description string, content string, src string, "
                               "type string, total_posts string, tags array<string>, education array<string>, is_date_extended boolean")
    for made in (E.detect_education(df, "src"), E.detect_tags(df, "src"), E.default_tags(df), E.apply_update_signals(df, "src"), E.match_summary(df, "content")):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan and plan.count("ArrowEvalPython") == 1

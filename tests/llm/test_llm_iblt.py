"""Invertible Bloom lookup sketches against exact set differences."""
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from gazette.llm import iblt


def units(text):
    out = []
    for line in re.split("\n+", text or ""):
        out += re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", line) if len(line) > iblt.LONGEST_PARAGRAPH else [line]
    return {u.strip(" ") for u in out} - {""}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(df):
    rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    ids = sorted(i for i, _ in rows if i is not None)
    got = iblt.fingerprint_edits(df).collect()
    assert len(got) == len(rows)
    single = {i: t for i, t in rows if ids.count(i) == 1}
    prints = {}
    for r in got:
        if r["doc_id"] not in single:
            continue
        text = single[r["doc_id"]]
        following = [i for i in ids if i > r["doc_id"]] or ids
        if len(set(following)) > 0 and ids.count(following[0]) > 1:
            continue
        new = single[following[0]]
        half = len(text) // 2
        edited = text[:len(text) - half] + new[:half]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(jaccard(units(text), units(edited)), abs=1e-12)
        assert r["near_next"] == pytest.approx(jaccard(units(text), units(new)), abs=1e-12)
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (units(text) == units(edited))
    return got


def test_fingerprint_edits(documents, odd, none):
    check(documents)
    got = check(odd)
    assert sum(r["near_next"] is None for r in got) == 2
    assert iblt.fingerprint_edits(none).count() == 0


def test_one_row(spark):
    r = iblt.fingerprint_edits(spark.createDataFrame([(7, "A b. C d.")], "doc_id long, text string")).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"A b. A b.").hexdigest()


def test_digests_are_recovered(spark):
    rows = [(n, "\n".join(f"line {k}" for k in range(n)), "\n".join(f"line {k}" for k in range(n // 2, n + n // 3))) for n in (0, 1, 2, 5, 40, 300, 4000)]
    rows += [(-1, "a\nb", None), (-2, None, None), (-3, "a\nb", "b\na")]
    df = spark.createDataFrame(rows, "id int, old string, new string")
    got = {}
    for r in iblt.differing_digests(df, "id", "old", "new").collect():
        got.setdefault(r["id"], []).append((r["sign"], r["digest"]))
    names = sorted({u for _, a, b in rows for u in units(a) | units(b)})
    digest = {r["u"]: r["d"] for r in spark.createDataFrame([(u,) for u in names], "u string").select("u", F.xxhash64("u").alias("d")).collect()}
    for i, a, b in rows:
        want = [(1, digest[u]) for u in units(a) - units(b)] + [(-1, digest[u]) for u in units(b) - units(a)]
        assert sorted(got.get(i, [])) == sorted(want)


def test_retries_and_the_direct_way(spark):
    old = "\n".join(f"x{k}" for k in range(500))
    rows = spark.createDataFrame([(0, 1, old, ""), (0, 2, old, old + "\nmore"), (0, 3, "x", "y")], "b int, k int, old string, new string").repartition(2, "b")
    rows = rows.select("b", "k", F.struct(iblt.digests(F.col("old")).alias("own"), F.array(iblt.digests(F.col("new"))).alias("others")).alias("payload"))
    got = {r["k"]: r["payload"] for r in iblt.compared(rows, 1, sizes=(8, 64), rounds=(6, 9)).collect()}
    assert [got[k]["differ"][0] for k in (1, 2, 3)] == [500, 1, 2]
    assert [got[k]["at"][0] for k in (1, 2, 3)] == [0, 8, 8]
    got = {r["k"]: r["payload"] for r in iblt.compared(rows, 1).collect()}
    assert [got[k]["differ"][0] for k in (1, 2, 3)] == [500, 1, 2]
    assert got[1]["at"][0] > 8


def test_no_python_and_no_wide_cells(documents):
    plan = iblt.fingerprint_edits(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert plan.count("Exchange") <= 1

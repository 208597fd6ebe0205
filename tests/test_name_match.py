"""E8 against a table: the rows of all pairs, whatever the threshold of common words, and bounded work."""
import random

import pytest
from pyspark.sql import functions as F

from gazette.operators.enrich import match_dim_by_name
from gazette.operators.name_match import containing, match_dim_table, word_pairs

DIM = "ordinal int, id string, name string"


def _both(spark, names, entries, common):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    dim = spark.createDataFrame([(k + 1, str(x), n) for k, (x, n) in enumerate(entries)], DIM)
    cols = ["i", "x_id", "x_match", "x_score"]
    got, want = (sorted(tuple(r) for r in m.select(*cols).collect())
                 for m in (match_dim_table(df, "name", dim, "x", common), match_dim_by_name(df, "name", entries, "x")))
    return got, want


@pytest.mark.parametrize("common", [0, 2, 256])
def test_same_rows_as_all_pairs(spark, common):
    rng = random.Random(common)
    words = ["a", "ab", "of", "state", "new", "delhi", "york", "ñandú", "b", "north", "northern"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(1, n)))
    entries = [(100 + k, some(4)) for k in range(40)] + [(7, "State"), (8, "state "), (9, "")]
    names = [some(5) for _ in range(150)] + [None, "", "  ", "STATE", "of of of", "xyz", "zz delhizz", "\tnew york", "new\t york  b"]
    got, want = _both(spark, names, entries, common)
    assert got == want and sum(r[1] is not None for r in got) > 100


def test_common_words_make_no_pairs(spark):
    """Two words that every name and every candidate holds: all of them meet as one pair of sets."""
    n = 1500
    names = spark.createDataFrame([(f"govt of place{k}",) for k in range(n)], "q string")
    cands = spark.createDataFrame([(k + 1, str(k), f"govt of region{k}" if k % 3 else f"govt of place{k}") for k in range(n)],
                                  "ordinal int, id string, lname string")
    rare, met = word_pairs(names, cands)[:2]
    assert rare.count() == n // 3 and met.count() == 1
    out = {r.q: (r.x_id, r.x_match) for r in match_dim_table(names.withColumn("name", F.col("q")), "name",
                                                             cands.withColumnRenamed("lname", "name"), "x").collect()}
    assert out["govt of place3"] == ("3", "exact") and out["govt of place4"] == ("42", "fuzzy") and out["govt of place1499"] == ("0", "fuzzy")


def test_long_names_are_linear(spark):
    """A name of 5,000 characters and one of 40,000: grams grow with the length, not with its square."""
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(40_000)).strip()
    names = [long[:5000].strip(), long, "x" * 5000]
    got, want = _both(spark, names, [(1, long[100:4000].strip()), (2, long[6000:30_000].strip()), (3, "x" * 17), (4, "y")], 256)
    assert got == want and got[0][1] == "1" and got[1][1] == "2" and got[2][1] == "3"


def test_containing(spark):
    texts = spark.createDataFrame([("abcdefghij",), ("abc",), ("",), ("é",)], "t string")
    parts = spark.createDataFrame([("cdefghi",), ("abc",), ("b",), ("",), ("é",), ("abcdefghijk",), ("hgf",), ("bcdefghij",)], "p string")
    assert sorted(map(tuple, containing(texts, parts).collect())) == [
        ("abc", "abc"), ("abc", "b"), ("abcdefghij", "abc"), ("abcdefghij", "b"), ("abcdefghij", "bcdefghij"), ("abcdefghij", "cdefghi"), ("é", "é")]


def test_empty_tables(spark):
    assert _both(spark, ["a"], [(1, "b")], 256)[0] == [(0, None, None, None)]
    df = spark.createDataFrame([], "name string")
    assert match_dim_table(df, "name", spark.createDataFrame([], DIM), "x").count() == 0

"""Exact dedup by content sort and SimHash near-dedup against brute force."""
import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from gazette.llm.exact_dedup import content_sort, dedup
from gazette.llm.simhash import components, edges, fingerprints, keep_one, linked, gray_rank, near_dedup, simhash


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_groups(rows, best):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    return {t: (best([x for x in g if x is not None], default=None), len(g)) for t, g in groups.items()}


def check(df, keep):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = brute_groups(rows, max if keep == "largest" else min)
    got = content_sort(df, keep=keep).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    kept = {}
    for r in got:
        assert (r["keep_id"], r["group_size"]) == by_sha[r["text_sha256"]]
        kept[r["text_sha256"]] = kept.get(r["text_sha256"], 0) + r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) <= {1} and len(kept) == len(want)


def test_content_sort(spark, documents, odd, none):
    for df in (documents, odd):
        for keep in ("largest", "smallest"):
            check(df, keep)
    assert content_sort(none).count() == 0


def test_a_group_over_many_ranges(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "HOT text").when(
        F.col("id") % 3 == 1, "hot TEXT").otherwise(F.concat(F.lit("cold "), F.col("id").cast("string"))).alias("text"))
    check(rows, "largest")


def test_dedup_keeps_columns(odd):
    got = dedup(odd)
    assert got.columns == odd.columns
    assert got.count() == len({lower(r["text"]) for r in odd.collect()})


def brute_simhash(text, k=3):
    words = lower(text).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, distance=2):
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_simhash_and_spark_hash(spark, documents, odd):
    for df in (documents, odd):
        for r in df.limit(60).collect():
            assert simhash(r["text"]) == brute_simhash(r["text"])
    assert spark.sql("SELECT xxhash64('a b c') x").first()["x"] == np.uint64(xxhash.xxh64_intdigest(b"a b c", seed=42)).view(np.int64)


def test_linked_finds_every_pair():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(5)]
    codes = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(120)}
    a = np.array(sorted(codes), np.uint64)
    a = a[np.argsort(gray_rank(a))]
    want = {(i, j) for i in range(len(a)) for j in range(i) if (int(a[i]) ^ int(a[j])).bit_count() <= 2}
    got = {(int(i), int(j)) for p in linked(a, 2) for i, j in zip(*p)}
    assert got == want


def test_gray_rank():
    assert [int(x) for x in gray_rank(np.array([0, 1, 3, 2, 6, 7, 5, 4], np.uint64))] == list(range(8))


def test_components_of_planted_codes(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(30)]
    codes = list({b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(5))) for b in base for _ in range(30)})
    signed = [(int(np.uint64(c).view(np.int64)),) for c in codes]
    df = spark.createDataFrame(signed, "fp long")
    got = {r["node"]: r["root"] for r in components(edges(df, 2)).collect()}
    want = brute_components(codes)
    groups, mine = {}, {}
    for (s,), c in zip(signed, codes):
        groups.setdefault(want[c], set()).add(s)
        mine.setdefault(got.get(s, s), set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    assert {r["root"] for r in components(chain).collect()} == {0}


def test_near_dedup(documents, odd, none):
    for df in (documents, odd):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        fps = [brute_simhash(t) for _, t in rows]
        root = brute_components(fps)
        least = {}
        for (i, _), f in zip(rows, fps):
            if i is not None:
                least[root[f]] = min(i, least.get(root[f], i))
        want = sorted(((i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, fps)), key=str)
        got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in near_dedup(df).collect()), key=str)
        assert got == want
    assert near_dedup(none).count() == 0
    kept = keep_one(documents)
    assert kept.columns == documents.columns
    rows = near_dedup(documents).collect()
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["component_id"] for r in rows})
    assert fingerprints(none).count() == 0


def test_one_row_of_each_component_stays(spark):
    a, b = "one two three four five six seven eight", "red blue green grey black white pink brown"
    rows = [(None, a, "p"), (None, a, "q"), (None, b, "p"), (4, b, "p"), (4, b, "q"), (4, b.upper(), "p"), (None, None, "p"), (9, "", "p"), (10, "", "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for parts in (1, 4):
        got = [(r["doc_id"], (r["text"] or "").lower()) for r in keep_one(df.repartition(parts)).collect()]
        assert sorted(got, key=str) == [(4, b), (9, ""), (None, a)]
    assert keep_one(df).columns == df.columns


def test_kept_rows_may_have_any_columns(spark, odd, none):
    names = ["none", "id", "rank", "whole", "place", "first_none", "first_id", "first_rank", "__id", "__none", "__rank", "__whole", "__place", "least", "root", "name", "row"]
    df = odd.select("doc_id", "text", "lang", "source", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    got = keep_one(df)
    assert got.columns == df.columns
    plain = keep_one(odd.select("doc_id", "text", "lang", "source"))
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(r["doc_id"]) for r in plain.collect()) == ["0", "2", "4", "5", "6", "6"]
    assert keep_one(none).count() == 0

"""Poisson mixing and harmonic packing against brute force."""
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gazette.llm.mixing import mix, poisson_mix
from gazette.llm.packing import cuts, pack
from gazette.llm.queries import WORD_BPE, tokenizer_file


def drawn(name, mean):
    total = 0
    draws = max(1, math.ceil(mean / 64))
    for j in range(1, draws + 1):
        u = int(hashlib.md5(f"{name}#{j}".encode()).hexdigest()[:13], 16) / 2**52
        m = mean / draws
        p = c = math.exp(-m)
        k = 0
        while c <= u and k < math.ceil(m + math.sqrt(m) * 12 + 30):
            k += 1
            p = p * m / k
            c += p
            total += 1
    return total


def brute_mix(rows, weights):
    n = Counter(s for _, s, _ in rows)
    w = {s: round(weights.get(s, 1) * 1000) for s in n}
    out = Counter()
    for i, s, t in rows:
        rate = len(rows) * w[s] / (sum(w.values()) * n[s])
        for k in range(1, drawn(f"5:{'null' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}", rate) + 1):
            out[i, s, k] += 1
    return out


def test_mix_against_brute_force(documents, odd, none):
    for df, weights in ((documents, {"src0": 5.0, "src1": 400.0}), (odd, {"a": 2.5}), (odd, {})):
        rows = [(r["doc_id"], r["source"], r["text"]) for r in df.collect()]
        got = Counter((r["doc_id"], r["source"], r["copy"]) for r in poisson_mix(df, weights=weights).collect())
        assert got == brute_mix(rows, weights)
    assert poisson_mix(none).count() == 0
    assert mix(odd).columns == odd.columns


def test_mix_meets_the_weights(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("source"))
    got = {r["source"]: r["count"] for r in poisson_mix(df, weights={"a": 1, "b": 3}).groupBy("source").count().collect()}
    assert abs(got["b"] / 22_500 - 1) < 0.03 and abs(got["a"] / 7_500 - 1) < 0.04


def test_rows_without_ids_are_drawn_on_their_own(spark):
    """A third of the ids null and one hot id: the counts vary within each, and the copies reach all tasks."""
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("doc_id"),
                                  F.concat(F.lit("text "), "id").alias("text"), F.lit("a").alias("source"))
    got = poisson_mix(df, weights={}, epochs=0.5)
    for some in ("doc_id is null", "doc_id = 7"):
        n = got.filter(some).count()
        assert abs(n / 1000 - 1) < 0.12  # 2,000 rows, half a copy each
        assert got.filter(some).select("copies").distinct().count() >= 3
        assert got.filter(some).select(F.spark_partition_id()).distinct().count() == got.rdd.getNumPartitions()


def test_pieces_without_ids_reach_all_workers(spark, monkeypatch):
    monkeypatch.setattr("gazette.llm.packing.PIECES_PER_WORKER", 100)
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("some words here")).alias("text"))
    rows = [r.asDict() for r in pack(df, tokenizer_file(WORD_BPE)).collect()]
    assert sorted((str(r["doc_id"]), r["length"]) for r in rows) == sorted(
        (str(r["doc_id"]), 4 if r["text"] else 1) for r in df.collect())
    sequences = Counter()
    for r in rows:
        sequences[r["sequence_id"]] += r["length"]
    assert max(sequences.values()) <= 4096 and len({r["sequence_id"] for r in rows if r["doc_id"] is None}) >= 1


def test_cuts():
    for n in range(1, 13_000, 7):
        parts = cuts(n, 4096, 64)
        assert sum(size for _, size, _ in parts) == n
        at = 0
        for start, size, j in parts:
            assert start == at and 4096 - 64 <= j * size <= 4096
            at += size


def check_pack(df):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_file(WORD_BPE))
    want = Counter()
    for r in df.collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want[r["doc_id"], zlib.crc32(np.asarray(ids, "<u4").tobytes()), len(ids)] += 1
    rows = pack(df, tokenizer_file(WORD_BPE)).collect()
    assert sum(r["length"] for r in rows) == sum(n * k for (_, _, n), k in want.items())
    texts = {r["doc_id"]: [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in df.collect()}
    ids = Counter(r["doc_id"] for r in df.collect())
    bins = {}
    for r in rows:
        if ids[r["doc_id"]] == 1:
            part = texts[r["doc_id"]][r["start"]:r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.asarray(part, "<u4").tobytes()) and r["doc_tokens"] == len(texts[r["doc_id"]])
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for off, size in sorted(parts):
            assert off == at
            at += size
        assert at <= 4096
    return sum(r["length"] for r in rows), len(bins)


def test_pack(documents, odd, none):
    used, bins = check_pack(documents)
    assert used > 0.97 * 4096 * (bins - 1)
    check_pack(odd)
    assert pack(none, tokenizer_file(WORD_BPE)).count() == 0


def test_pack_many_workers(spark, documents, monkeypatch):
    import gazette.llm.packing as packing
    monkeypatch.setattr(packing, "PIECES_PER_WORKER", 40)
    used, bins = check_pack(documents)
    assert used > 0.97 * 4096 * (bins - 1)


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer
    from gazette.llm.packing import WordIds
    path = tokenizer_file(WORD_BPE)
    tok, words = Tokenizer.from_file(path), WordIds(path)
    texts = ["", " ", "a  b", "Don't we'll ́e é x\t\ny \x1cz", "<|endoftext|> a<|startoftext|>b", "é" * 300, "漢字 12345 !?..  q",
             "İstanbul ΣΑΣ ς", "ا ب‏ج", "'s 't a's 12'd", "x" * 70 + " " + "y" * 64, "Été. ÀÉ, ß; ſ ǅ! µ º ª ŉ İ. a.b. 1. x'. ... .. don't. e\u0301. É.É",
             "word, Word. WORD! word? wörd: ǰ Ǆ K Å", "\u00a0x a\u00a0b. \u3000"]
    for t, got in zip(texts, words.ids(texts)):
        assert list(np.frombuffer(got, "<u4")) == tok.encode(t, add_special_tokens=False).ids, t


def test_words_are_looked_up_once_a_batch(monkeypatch):
    """A word costs one look-up a batch however often it comes, and the ids are the library's, with tables that are cut too."""
    import numpy as np
    from gazette.llm import packing
    from gazette.llm.queries import WORD_BPE, tokenizer_file
    monkeypatch.setattr(packing, "CACHED_WORDS", 6)
    monkeypatch.setattr(packing, "KEPT_WORDS", 3)

    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return super().get(*a)

        def __contains__(self, k):
            Counted.asked += 1
            return super().__contains__(k)

    words = packing.WordIds(tokenizer_file(WORD_BPE))
    many = "one  two\nthree, " * 1000
    for texts in (["", "\n", " "], [many, "", many + "x" * 100], ["Été straße 你好 one", "a b\tc   d!?", many], [many + "four five six seven"]):
        words.known = Counted(words.known)
        want = [np.asarray(words.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert words.ids(texts) == want
    assert Counted.asked < 200

"""Sentence spans and the log-bilinear model."""
import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gazette.llm import lm
from gazette.llm.sentence_spans import remove_spans, runs, split


def brute_spans(rows, least=2, words=12):
    """For each row the kept text, in the order of ids (null last)."""
    key = lambda i: math.inf if i is None else i
    norm = lambda s: " ".join("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s).split())
    owner, made = {}, []
    for i, t in rows:
        parts, seps = split(t or "")
        own = []
        real = [k for k, s in enumerate(parts) if norm(s)]
        for a in range(len(real)):
            for b in range(a + least, len(real) + 1):
                chosen = [norm(parts[k]) for k in real[a:b]]
                if sum(len(s.split()) for s in chosen) >= words:
                    own.append((real[a], real[b - 1] + 1, tuple(chosen)))
                    break
        made.append((i, t, parts, seps, own))
        for _, _, s in own:
            owner[s] = min(key(i), owner.get(s, math.inf))
    out = []
    for i, t, parts, seps, own in made:
        gone, seen, of = set(), set(), set()
        for a, b, s in own:
            if owner[s] < key(i):
                of.add(owner[s])
            if owner[s] < key(i) or s in seen:
                gone |= {k for k in range(a, b) if norm(parts[k])}
            seen.add(s)
        out.append((i, t if t is None else "".join(p + q for k, (p, q) in enumerate(zip(parts, seps)) if k not in gone), len(gone), sorted(of)))
    return sorted(out, key=str)


def test_spans(spark, documents, odd, none):
    a = "One two three four five six. Seven eight nine ten eleven twelve thirteen. Fourteen fifteen sixteen. "
    rows = [(1, a + "Tail of the first document here."), (2, "Head. " + a + "Other tail."), (3, a + a + "End."), (4, "One two three four five six."),
            (None, a), (5, "Of. The. Of. The."), (5, "Of. The. Of. The."), (6, "x. \n\n y! " + a.upper() + "\n")]
    planted = spark.createDataFrame(rows, "doc_id long, text string")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for df in (planted, documents, odd.drop("id", "t"), odd, docs):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        got = sorted(((r["doc_id"], r["text"], r["removed_sentences"], r["repeats_of"]) for r in remove_spans(df).collect()), key=str)
        assert got == brute_spans(rows)
    assert remove_spans(none).count() == 0


def test_runs_cover_the_fewest_sentences():
    parts = ["A b c.", "", "D e f g.", "H.", "I j k l m n o p."]
    assert [(a, b) for a, b, _ in runs(parts, 2, 7)] == [(0, 3), (2, 5), (3, 5)]
    assert split("A b.  C\n\nd? e")[0] == ["A b.", "C", "d?", "e"]


def test_long_sentences_are_cut(spark):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, glued = text(60), "".join(rng.choice(list("一二三四五六七八九十百千"), 400))
    rows = [(1, f"{text(9)} {shared} {text(11)}"), (2, f"{text(23)} {shared.upper()} {text(30)}. Short."),
            (3, f"{text(5)} {shared}"), (4, glued), (5, text(20) + "字字字" + glued + "字"), (6, text(70))]
    got = {r["doc_id"]: r for r in remove_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["text"] == t for i, t in rows] == [True, False, False, True, False, True]
    assert [got[i]["repeats_of"] for i in (2, 3, 5)] == [[1], [1], [4]]
    for i, t in rows[1:3]:
        assert len(t.split()) - len(got[i]["text"].split()) >= 60 - 2 * 16
    assert len(got[5]["text"]) < len(rows[4][1]) - 340
    for _, t in [*rows, (7, "a " * 40 + "b" * 90 + "  c,  d;\ne。f, " + text(30) + " ")]:
        parts, seps = split(t)
        assert "".join(p + s for p, s in zip(parts, seps)) == t
        assert all(len(p.split()) <= 16 and len(w) <= 32 for p in parts for w in p.split())


def test_rows_of_one_id_are_documents(spark):
    a = "One two three four five six. Seven eight nine ten eleven twelve thirteen. "
    b = "Red blue green grey black white. Pink brown gold teal lime rose navy. "
    rows = [(None, a + "x."), (None, a + "y."), (None, a + "y."), (7, b + "v."), (7, b + "w."), (3, b), (8, "Own. " + a), (9, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 5):
        got = sorted(((r["doc_id"], r["text"], r["repeats_of"]) for r in remove_spans(df.repartition(parts)).collect()), key=str)
        assert got == sorted([(None, "x.", [8]), (None, "y.", [8]), (None, "y.", [8]), (7, "v.", [3]), (7, "w.", [3]), (3, b, []),
                              (8, "Own. " + a, []), (9, "", [8])], key=str)
    nameless = [(None, a), (None, a), (None, a), (5, b), (5, b), (5, b + "End.")]
    got = remove_spans(spark.createDataFrame(nameless, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["text"] in (a, b, b + "End."), r["repeats_of"]) for r in got) == [
        ("5", False, [5]), ("5", False, [5]), ("5", True, []), ("None", False, []), ("None", False, []), ("None", True, [])]


def model_of(rows, learn):
    counts = Counter()
    for i, t in rows:
        if learn(i):
            counts.update([*(w.decode() for w in (t or "").encode().lower().split()), ""])
    return counts


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 == 2


def check_scores(df, **how):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    counts = model_of(rows, lambda i: not held(i))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        tokens = [*(w.decode() for w in (t or "").encode().lower().split()), ""]
        want.append((str(i), held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), 4)))
    got = lm.score_texts(df, F.crc32(df["doc_id"].cast("string").cast("binary")) % 7 != 2, **how).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == sorted(want)
    return got


def test_scores(spark, documents, odd, none):
    check_scores(documents, common=300, listed=60, classes=8)
    check_scores(odd)
    assert lm.score_texts(none, F.lit(True)).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r for r in check_scores(docs) if r["held_out"]]
    assert sum(r["score"] for r in got) > 0.97 * sum(r["base_score"] for r in got)  # both negative


def test_the_model_is_normalised(spark, documents):
    counts = lm.word_counts(documents, "text")
    vocab = lm.vocabulary(counts, 40, 8, 100)
    model = lm.train(documents, vocab, "text", 8, 16, 256, 0.1, 1)
    table = lm.tables(spark, model)
    n = vocab.size
    w = np.arange(n)
    for h1, h2 in ((0, 1), (5, 5), (n - 1, 3)):
        p = 10 ** table.log10(w, np.full(n, h1), np.full(n, h2))
        assert abs(p.sum() - 1) < 1e-4
        s = (model["r"][h1] @ model["c"][0] + model["r"][h2] @ model["c"][1]) @ model["q"].T + model["b"]
        assert np.allclose(np.log(p), s - np.log(np.exp(s).sum()), atol=1e-4)
    assert vocab.class_tokens.sum() + vocab.counts[:40].sum() == vocab.tokens
    assert vocab.class_words.sum() + 40 == vocab.distinct


def test_noise_contrast_learns_the_context():
    rng = np.random.default_rng(0)
    w = np.zeros(40_000, np.int64)
    for k in range(1, len(w)):  # a chain that mostly steps on by one
        w[k] = (w[k - 1] + 1) % 10 if rng.random() < 0.9 else rng.integers(10)
    shares = np.bincount(w, minlength=10) / len(w)
    vocab = lm.Vocabulary([str(k) for k in range(10)], np.bincount(w, minlength=10), 10, 0, np.zeros(0), np.zeros(0), len(w), 10)
    t = lm.Trainer(lm.start(vocab, 16, 0), shares, 16, 0.1, 0)
    h1, h2 = np.r_[0, w[:-1]], np.r_[0, 0, w[:-2]]
    for _ in range(4):
        for at in range(0, len(w), 500):
            t.step(w[at:at + 500], h1[at:at + 500], h2[at:at + 500])
    s = (t.p["r"][h1] @ t.p["c"][0] + t.p["r"][h2] @ t.p["c"][1]) @ t.p["q"].T + t.p["b"]
    p = np.exp(s - s.max(1, keepdims=True))
    got = np.log(p[np.arange(len(w)), w] / p.sum(1)).mean()
    best = 0.91 * math.log(0.91) + 0.09 * math.log(0.01)
    assert got > best - 0.1


def test_rows_add_up():
    ids = np.array([3, 1, 3, 0])
    assert lm.summed(ids, np.ones((4, 2), np.float32), 5).tolist() == [[1, 1], [1, 1], [0, 0], [2, 2], [0, 0]]

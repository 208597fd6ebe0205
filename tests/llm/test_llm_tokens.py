"""Token alignment, token counts and periodic runs, each against brute force."""
import bisect
import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gazette.llm import periodic_runs as runs
from gazette.llm.queries import BYTE_BPE, PIECE_BPE, looped, op11_token_alignment, op12_token_counts, op13_periodic_runs, tokenizer_file
from gazette.llm.token_alignment import align_tokens, byte_level_bytes
from gazette.llm.token_counts import Splitter, TokenCounter, count_tokens, cut_long
SF = "/root/testdata/sf0.001"

PARTS = [" ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", "'s", "'re", "'r", "'", "'ll", "a", "the", "Word", "lll", "12", "!", ".,", "é",
         "世", "𓀀", "<|endoftext|>", "<0x0A>", "<s>", "</s>", "<unk>", "aaaa", "ab", "½", "²", "́", "D'", ");", "\x00", "▁"]
ODD = ["", " ", "\n", "a" * 3000, "ab" * 2000, " " * 500 + "x", "=-" * 900, "世界" * 400, "x" + "́" * 300]


def odd_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices(PARTS, k=r.randint(0, 25))) for _ in range(n)] + ODD


@pytest.fixture(scope="module")
def byte_bpe():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_file(BYTE_BPE))


# ---------------------------------------------------------------- 12

@pytest.fixture(scope="module")
def counter():
    return TokenCounter(tokenizer_file(BYTE_BPE))


def test_counts_equal_the_library(counter, byte_bpe, documents):
    texts = odd_texts(3000, 1) + [r["text"] or "" for r in documents.select("text").collect()]
    sizes, tokens = counter.count(texts)
    assert sizes == [len(t.encode()) for t in texts]
    assert tokens == [len(byte_bpe.encode(t, add_special_tokens=False).ids) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text(alphabet=" \n\t'srevl12!é", max_size=60), max_size=5))
def test_counts_of_any_text(counter, byte_bpe, texts):
    assert counter.count(texts)[1] == [len(byte_bpe.encode(t, add_special_tokens=False).ids) for t in texts]


def test_words_longer_than_chunks(counter, byte_bpe):
    r = random.Random(2)
    texts = ["".join(r.choices("abcdefg", k=20_000)), "aab" * 5000, "x " + "ß" * 4001, "!?" * 3000 + "abc"]
    assert counter.count(texts)[1] == [len(byte_bpe.encode(t, add_special_tokens=False).ids) for t in texts]


def test_cleared_tables_count_the_same(byte_bpe, monkeypatch):
    monkeypatch.setattr("gazette.llm.token_counts.MOST_STATES", 50)
    small, texts = TokenCounter(tokenizer_file(BYTE_BPE)), odd_texts(40, 3)
    for t in texts:
        assert small.count([t])[1] == [len(byte_bpe.encode(t, add_special_tokens=False).ids)]


def test_long_texts_are_cut_where_words_start(byte_bpe, monkeypatch):
    monkeypatch.setattr("gazette.llm.token_counts.CHARS_AT_ONCE", 50)
    text = "".join(random.Random(4).choices(PARTS[:-1], k=4000))
    cut = list(cut_long(text))
    assert "".join(cut) == text and len(cut) > 10
    count = lambda t: len(byte_bpe.encode(t, add_special_tokens=False).ids)
    assert sum(map(count, cut)) == count(text)


def test_scan_composes_state_maps():
    r = np.random.default_rng(0)
    maps = r.integers(0, 12, (12, 77)).astype(np.uint8)
    state, want = 0, []
    for k in range(77):
        want.append(state)
        state = maps[state, k]
    assert Splitter.entries(maps).tolist() == list(map(int, want))


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        TokenCounter(tokenizer_file("word_bpe_49k.json"))


def test_count_rows(spark, odd, none, byte_bpe):
    got = count_tokens(odd, tokenizer_file(BYTE_BPE))
    want = [(r["doc_id"], len((r["text"] or "").encode()), n := len(byte_bpe.encode(r["text"] or "", add_special_tokens=False).ids), n > 1024)
            for r in odd.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert count_tokens(none, tokenizer_file(BYTE_BPE)).count() == 0


def test_count_query(spark, documents, byte_bpe):
    got = {r["doc_id"]: r["n_tokens"] for r in op12_token_counts(spark, SF).collect()}
    assert got == {r["doc_id"]: len(byte_bpe.encode(r["text"] or "", add_special_tokens=False).ids) for r in documents.select("doc_id", "text").collect()}


# ---------------------------------------------------------------- 11

@pytest.fixture(scope="module")
def brute_groups(byte_bpe):
    """(ids of A, ids of B) of each group of a text, by whole-text encoding."""
    import sentencepiece
    from tokenizers import Tokenizer
    a_tool = Tokenizer.from_file(tokenizer_file(BYTE_BPE))
    a_tool.encode_special_tokens = True
    b_tool = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(PIECE_BPE))
    spelled = {k: t for t, k in a_tool.get_vocab().items()}

    def piece_bytes(k):
        p = b_tool.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if b_tool.is_byte(k) else p.replace("▁", " ").encode()

    def groups(text):
        if not text:
            return []
        a, b = a_tool.encode(" " + text, add_special_tokens=False).ids, b_tool.encode(text)
        x, y = [byte_level_bytes(spelled[k]) for k in a], [piece_bytes(k) for k in b]
        if not b"".join(x) == b"".join(y) == (" " + text).encode():
            return []
        a_end, b_end = list(itertools.accumulate(map(len, x))), list(itertools.accumulate(map(len, y)))
        out, s, t = [], 0, 0
        for e in sorted(set(a_end) & set(b_end)):
            i, j = bisect.bisect(a_end, e), bisect.bisect(b_end, e)
            out.append((a[s:i], b[t:j]))
            s, t = i, j
        return out

    return groups


def brute_rows(rows, brute_groups):
    groups = [brute_groups(t) for _, t in rows]
    counts = collections.Counter((a[-1], b[-1]) for g in groups for a, b in g)
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for (doc, _), g in zip(rows, groups):
        links = [(a[-1], b[-1]) for a, b in g]
        out.append((doc, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(counts[p] == most[p[1]] for p in links),
                    sum(counts[p] for p in links), ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [2_000_000, 300])
def test_alignment_equals_whole_texts(spark, brute_groups, monkeypatch, block):
    monkeypatch.setattr("gazette.llm.token_alignment.BLOCK_CHARS", block)
    monkeypatch.setattr("gazette.llm.token_alignment.CHARS_AT_ONCE", block // 2)
    rows = list(enumerate(odd_texts(400, 5) + ["The quick brown fox, jumped. 12 times!"] * 30)) + [(None, None), (None, "a b"), (3, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = align_tokens(df, tokenizer_file(BYTE_BPE), tokenizer_file(PIECE_BPE))
    assert sorted(map(tuple, got.collect()), key=str) == brute_rows(rows, brute_groups)


def test_alignment_rows(spark, odd, none, brute_groups):
    got = align_tokens(odd, tokenizer_file(BYTE_BPE), tokenizer_file(PIECE_BPE))
    assert sorted(map(tuple, got.collect()), key=str) == brute_rows([tuple(r) for r in odd.select("doc_id", "text").collect()], brute_groups)
    assert align_tokens(none, tokenizer_file(BYTE_BPE), tokenizer_file(PIECE_BPE)).count() == 0


def test_alignment_query(spark, documents, brute_groups):
    want = brute_rows([tuple(r) for r in documents.select("doc_id", "text").collect()], brute_groups)
    want = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in want]
    got = op11_token_alignment(spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


# ---------------------------------------------------------------- 13

def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                found.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def periodic(r, n, letters):
    words = [r.randrange(letters) for _ in range(n)]
    for _ in range(r.randint(0, 3) if n > 6 else 0):
        a = r.randrange(n)
        b = r.randint(a, n)
        p = r.randint(1, max(1, (b - a) // 4))
        words[a:b] = [words[a + (i - a) % p] for i in range(a, b)]
    return words


def test_runs_equal_brute_force():
    r = random.Random(6)
    texts = [periodic(r, r.choice([0, 1, 5, 6, 7, 20, 50, 120, 300]), r.choice([1, 2, 3, 5, 50])) for _ in range(600)]
    edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = runs.find_runs(np.asarray([w for t in texts for w in t], np.int64), edges)
    assert got == [brute_runs(t) for t in texts] and sum(map(len, got)) > 300


def test_runs_modulo_the_large_prime(monkeypatch):
    monkeypatch.setattr(runs, "FERMAT_CELLS", 16)  # longer transforms take the large prime
    r = random.Random(7)
    for _ in range(60):
        words = periodic(r, 400, 3)
        assert runs.find_runs(np.asarray(words, np.int64), np.asarray([0, 400])) == [brute_runs(words)]


def test_transform_convolves_exactly():
    r = np.random.default_rng(1)
    for prime in (runs.FERMAT, runs.LARGE_PRIME):
        for n in (2, 8, 64, 1024):
            x, y = r.integers(0, prime, (2, n, 3))
            got = runs.backward(runs.reduced(runs.forward(x, prime) * runs.forward(y, prime), prime), prime) % prime
            k = int(r.integers(n))
            want = sum(int(x[i, 1]) * int(y[(k - i) % n, 1]) for i in range(n)) * n % prime
            assert got[k, 1] == want


def test_long_periods():
    x = np.random.default_rng(2).integers(0, 90_000, 300_000)
    x[1000:] = x[1000 + np.arange(299_000) % 60_001]
    assert runs.find_runs(x, np.asarray([0, 300_000])) == [[(1000, 299_000, 60_001)]]
    assert runs.find_runs(np.zeros(200_000, np.int64), np.asarray([0, 200_000])) == [[(0, 200_000, 1)]]


def brute_looped(doc, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words[a:] = [words[a + (i - a) % p] for i in range(a, n)]
    return words


def brute_row(doc, text):
    words = brute_looped(doc, text)
    found = brute_runs(words)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    best = min(found, key=lambda f: (-f[1] / f[2], f[0], f[2]), default=(None, None, None))
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    return (doc, len(found), *best, best[1] * 1000 // best[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_run_query(spark, documents):
    got = op13_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    short = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((brute_row(*r) for r in short), key=str)


def test_run_rows(spark, odd, none):
    got = {(r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in runs.periodic_runs(odd).collect()}
    want = set()
    for r in odd.select("doc_id", "text").collect():
        words = (r["text"] or "").encode().split()
        if len(words) > 1000:  # "word" 60,000 times and an end
            want.add((r["doc_id"], 60_001, ((0, 60_000, 1),), "word end"))
        else:
            want.add((r["doc_id"], len(words), (), b" ".join(words).decode()))
    assert got == want
    assert runs.periodic_runs(none).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(odd, repeats=3)


def test_looped_texts(spark):
    rows = [(k, " ".join(f"w{i}" for i in range(k % 40)) + "\x0b\n z") for k in range(300)] + [(None, "a b"), (7, None), (9, " \t")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = looped(df).withColumn("n", F.lit(1)).collect()
    assert sorted((str(r["doc_id"]), (r["text"] or "").encode().split()) for r in got) == sorted((str(d), brute_looped(d, t)) for d, t in rows)

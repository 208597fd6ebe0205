"""Language ID: exact marginals and held-out accuracy."""
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from gazette.llm.langid import Emissions, Field, fit, forward_backward, identify, judge, learn, words_of


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(1)
    field = Field(["a", "b", "c"], None, rng.normal(size=(3, 3)), rng.normal(size=3), {})
    scores = [rng.normal(size=(n, 3)) for n in (4, 1, 5)]
    got, both, first = forward_backward(scores, field, pairs=True)
    pairs, starts = np.zeros((3, 3)), np.zeros(3)
    for s, g in zip(scores, got):
        want, total, moves, begin = np.zeros_like(s), 0, np.zeros((3, 3)), np.zeros(3)
        for path in product(range(3), repeat=len(s)):
            p = np.exp(field.start[path[0]] + sum(s[t, y] for t, y in enumerate(path))
                       + sum(field.transitions[x, y] for x, y in zip(path, path[1:])))
            total += p
            begin[path[0]] += p
            for t, y in enumerate(path):
                want[t, y] += p
            for x, y in zip(path, path[1:]):
                moves[x, y] += p
        assert np.allclose(g, want / total)
        pairs += moves / total
        starts += begin / total
    assert np.allclose(both, pairs) and np.allclose(first, starts)


def test_switches_and_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    field = learn(docs.filter(~held), per_language=120)
    rows = identify(docs.filter(held).select("doc_id", "text", "lang"), field).select("row.*", "lang_pred", "score").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    texts = {lang: next(r["text"] for r in rows if r["lang"] == lang and r["lang_pred"] == lang and r["score"] > 0.98) for lang in field.labels}
    words = [(w, lang) for lang in field.labels for w in texts[lang].split()[:40]]
    cache = Emissions(field)
    scores = [cache.of([w]) for w, _ in words]
    seq = np.concatenate(scores)
    said = forward_backward([seq], field)[0].argmax(1)
    gold = [field.labels.index(lang) for (_, lang), s in zip(words, scores) if len(s)]
    assert np.mean(said == gold) > 0.9
    assert np.diag(field.transitions).min() > (field.transitions - np.diag(np.diag(field.transitions))).max()


def test_odd_rows(spark, odd, none):
    field = fit([("the and of to", "en"), ("le et les des", "fr")] * 30)
    rows = identify(odd, field).select("row.text", "lang_pred", "score").collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
        assert 0 <= r["score"] <= 1
    assert identify(none, field).count() == 0
    empty = learn(none)
    assert {x for x, _ in judge(["a b", None], Emissions(empty))} == {"und"}
    one = learn(odd.filter("lang = 'en'"))
    assert judge(["some text"], Emissions(one))[0] == ("en", 1.0)


def test_runs_without_blanks_are_read_whole():
    en, zh, ja = "the and of to with from", "的一是不了人我在有他这中大来上国", "のにはをたがでてとしれさある"
    rng = np.random.default_rng(3)
    glued = lambda letters, n: "".join(rng.choice(list(letters), n))
    field = fit([(en, "en")] * 30 + [(glued(zh, 300), "zh") for _ in range(30)] + [(glued(ja, 300), "ja") for _ in range(30)])
    texts = [glued(zh, 400), glued(zh, 40) + glued(ja, 400), glued(ja, 40) + glued(zh, 400), glued(ja, 41)]
    cache = Emissions(field)
    assert [x for x, _ in judge(texts, cache)] == ["zh", "ja", "zh", "ja"]
    assert judge([texts[1]], cache)[0][1] < 0.99  # the first part is Chinese
    word = "x" * 39 + "yzzz"
    assert len(cache.of(words_of(f"-{word}. {word[:40]}"))) == 3
    assert words_of("a b--  c") == ["a", "b--", "c"] and words_of("-" * 50 + " a") == ["a"]

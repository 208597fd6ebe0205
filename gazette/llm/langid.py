"""Language identification with a linear-chain conditional random field over the words of a text.  A run of over
40 letters without a blank counts as several words, so that all of it is read.

A word's emission is the sum of learned weights of its features: the lexicons that list it, its prefixes,
suffixes and letter n-grams.  Learned transitions carry the label from word to word, so that a stray foreign
word does not flip its neighbours while a passage in another language does.  Forward-backward gives each
word's label distribution; a document's language has the largest mean over its words.

The field is fitted on a bounded, documented number of labelled documents per language; prediction reads
whole texts.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 15
LONGEST_WORD = 40  # letters; a longer run without blanks is several words
CACHED_WORDS = 250_000
CHARS_AT_ONCE = 1 << 24
CELLS_AT_ONCE = 1 << 20  # words (with padding) of one forward-backward pass
UNKNOWN = "und"


@dataclass
class Field:
    """labels, feature weights (BUCKETS, labels), transitions (labels, labels) and start scores as logs, and
    each lexicon word's best label with how far it stands out (1 to 3)."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    lexicon: dict[str, int]


def word_key(word: str) -> str:
    """Lower case without what is not a letter at either end; '' without letters."""
    if word.isalpha():
        return word.lower()
    a, b = 0, len(word)
    while a < b and not word[a].isalpha():
        a += 1
    while b > a and not word[b - 1].isalpha():
        b -= 1
    return word[a:b].lower()


def words_of(text: str) -> list[str]:
    """The words of a whole text; a longer one is there as its successive parts of ``LONGEST_WORD`` letters, so that a
    text in a script without blanks has as many positions as its length asks for."""
    words = text.split()
    if max(map(len, words), default=0) <= LONGEST_WORD:
        return words
    out = []
    for w in words:
        if len(w) > LONGEST_WORD:
            key = word_key(w)
            out += [key[k:k + LONGEST_WORD] for k in range(0, len(key), LONGEST_WORD)]
        else:
            out.append(w)
    return out


def features(key: str, lexicon: dict[str, int]) -> list[int]:
    """Buckets of a word's affixes and n-grams, in UTF-8 bytes, and of its lexicon entry; the CRC's start value
    tells the kinds apart."""
    w = f"^{key}$".encode()
    crc, last = zlib.crc32, BUCKETS - 1
    out = [crc(w[:2], 1) & last, crc(w[:3], 2) & last, crc(w[:4], 3) & last,
           crc(w[-2:], 4) & last, crc(w[-3:], 5) & last, crc(w[-4:], 6) & last]
    out += [crc(w[k:k + 2], 7) & last for k in range(1, len(w) - 2)]
    out += [crc(w[k:k + 3], 8) & last for k in range(len(w) - 2)]
    if key in lexicon:
        out.append(crc(b"%d" % lexicon[key], 9) & last)
    return out


class Emissions:
    """Emission scores of words, remembered for a bounded number of words; row 0 stands for "no letter"."""

    def __init__(self, field: Field):
        self.field, self.known, self.used = field, {}, 1
        self.table = np.zeros((1, len(field.labels)), np.float32)

    def add(self, words: list[str]) -> None:
        keys = [word_key(w) for w in words]
        lists = [features(k, self.field.lexicon) for k in keys if k]
        if self.used + len(lists) > len(self.table):
            grown = np.zeros((max(2 * len(self.table), self.used + len(lists)), self.table.shape[1]), np.float32)
            grown[: self.used] = self.table[: self.used]
            self.table = grown
        at = self.used
        if lists:
            starts = np.cumsum([0, *map(len, lists[:-1])])
            self.used += len(lists)
            self.table[at:self.used] = np.add.reduceat(self.field.weights[np.concatenate(lists)], starts, axis=0)
        for w, k in zip(words, keys):
            self.known[w] = at if k else 0
            at += bool(k)

    def of(self, words: list[str]) -> np.ndarray:
        """(n, labels): the scores of the n words that have a letter."""
        try:
            at = [self.known[w] for w in words]
        except KeyError:
            if len(self.known) > CACHED_WORDS:
                self.known, self.used = {}, 1
            self.add(list({w for w in words if w not in self.known}))
            at = [self.known[w] for w in words]
        at = np.asarray(at, np.int64)
        return self.table[at[at > 0]]


def forward_backward(scores: list[np.ndarray], field: Field, pairs: bool = False):
    """Label distributions of the words of each sequence, (n, labels); with ``pairs`` also the expected
    numbers of transitions and of starts."""
    order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
    sizes = np.asarray([len(scores[k]) for k in order])
    steps, labels = int(sizes[0]), len(field.labels)
    local = np.zeros((steps, len(order), labels), np.float64 if pairs else np.float32)
    for row, k in enumerate(order):
        s = scores[k]
        local[: len(s), row] = np.exp(s - s.max(1, keepdims=True))
    live = np.searchsorted(-sizes, -np.arange(steps), side="left")  # sequences longer than t
    move, first = np.exp(field.transitions).astype(local.dtype), np.exp(field.start).astype(local.dtype)
    ahead = np.zeros_like(local)
    a = first * local[0]
    a /= a.sum(1, keepdims=True)
    ahead[0] = a
    for t in range(1, steps):
        m = live[t]
        a = (a[:m] @ move) * local[t, :m]
        a /= a.sum(1, keepdims=True)
        ahead[t, :m] = a
    b = np.ones((len(order), labels), local.dtype)
    both, back = np.zeros((labels, labels)), move.T
    for t in range(steps - 1, 0, -1):
        m = live[t]
        lb = local[t, :m] * b[:m]
        if pairs:
            x = ahead[t - 1, :m, :, None] * move * lb[:, None, :]
            both += (x / x.sum((1, 2), keepdims=True)).sum(0)
        ahead[t, :m] *= b[:m]
        new = lb @ back
        b[:m] = new / new.sum(1, keepdims=True)
    ahead[0] *= b
    total = ahead.sum(2, keepdims=True)
    ahead /= np.where(total > 0, total, 1)
    out: list[np.ndarray] = [None] * len(order)
    for row, k in enumerate(order):
        out[k] = ahead[: len(scores[k]), row]
    return (out, both, sum(x[0] for x in out)) if pairs else out


# ---- learning -------------------------------------------------------------------------------------------

def spliced(texts: list[tuple[str, int]], length: int, rng: np.random.Generator) -> list[tuple[list[str], np.ndarray]]:
    """Sequences of about ``length`` words from runs of 8 to 64 words of the texts in random order, each word
    labelled with its text's language: the field sees switches between languages and texts' inner runs."""
    runs = []
    for text, label in texts:
        words = [w for w in words_of(text) if word_key(w)]
        at = 0
        while at < len(words):
            size = int(rng.integers(8, 65))
            runs.append((words[at:at + size], label))
            at += size
    out, words, labels = [], [], []
    for k in rng.permutation(len(runs)):
        words += runs[k][0]
        labels += [runs[k][1]] * len(runs[k][0])
        if len(words) >= length:
            out.append((words, np.asarray(labels)))
            words, labels = [], []
    return [*out, (words, np.asarray(labels))] if words else out


def fit(texts: list[tuple[str, str]], rounds: int = 4, batch: int = 64, length: int = 128, rate: float = 0.2,
        decay: float = 1e-6, least_count: int = 3, seed: int = 8) -> Field:
    """The field of labelled texts, by AdaGrad on the log-likelihood of spliced sequences."""
    labels = sorted({x for _, x in texts})
    number = {x: k for k, x in enumerate(labels)}
    rng = np.random.default_rng(seed)
    counts = [Counter() for _ in labels]
    for text, x in texts:
        counts[number[x]].update(filter(None, map(word_key, words_of(text))))
    sizes = np.asarray([max(1, c.total()) for c in counts], float)
    lexicon = {}
    for word, n in sum(counts, Counter()).items():
        if n >= least_count:
            share = np.asarray([c[word] for c in counts]) / sizes
            share = share / share.sum()
            best = int(share.argmax())
            lexicon[word] = 3 * best + int(np.searchsorted([0.7, 0.95], share[best], side="right"))
    field = Field(labels, np.zeros((BUCKETS, len(labels)), np.float32), np.zeros((len(labels),) * 2), np.zeros(len(labels)), lexicon)
    if len(labels) < 2:
        return field
    data = [(words, y) for words, y in spliced([(t, number[x]) for t, x in texts], length, rng)]
    vocabulary: dict[str, int] = {}
    data = [(np.asarray([vocabulary.setdefault(w, len(vocabulary)) for w in words]), y) for words, y in data]
    lists = [features(word_key(w), lexicon) for w in vocabulary]
    flat, sizes = np.concatenate(lists), np.asarray([len(x) for x in lists])
    starts = np.cumsum(sizes) - sizes
    squares = [np.full(field.weights.shape, 1e-6, np.float32), np.full(field.transitions.shape, 1e-6), np.full(field.start.shape, 1e-6)]
    for _ in range(rounds):
        for at in range(0, len(data), batch):
            part = [data[k] for k in rng.permutation(len(data))[:batch]] if at else data[:batch]
            words = np.concatenate([w for w, _ in part])
            used, back = np.unique(words, return_inverse=True)
            span = np.concatenate([np.arange(starts[u], starts[u] + sizes[u]) for u in used])
            ends = np.cumsum(sizes[used]) - sizes[used]
            scores = np.add.reduceat(field.weights[flat[span]], ends, axis=0)
            cut = np.cumsum([0, *(len(w) for w, _ in part)])
            seqs = [scores[back[a:b]].astype(float) for a, b in zip(cut, cut[1:])]
            got, both, first = forward_backward(seqs, field, pairs=True)
            gold = np.concatenate([y for _, y in part])
            miss = np.concatenate(got)
            miss[np.arange(len(gold)), gold] -= 1
            by_word = np.stack([np.bincount(back, miss[:, k], len(used)) for k in range(len(labels))], 1)
            by_use = np.repeat(by_word, sizes[used], axis=0)
            grad = np.stack([np.bincount(flat[span], by_use[:, k], BUCKETS) for k in range(len(labels))], 1)
            true = np.zeros_like(both)
            for _, y in part:
                np.add.at(true, (y[:-1], y[1:]), 1)
            begin = np.bincount([y[0] for _, y in part], minlength=len(labels))
            for value, g, q in zip((field.weights, field.transitions, field.start), (grad / batch, (both - true) / batch, (first - begin) / batch), squares):
                g = g + decay * value
                q += g * g
                value -= (rate * g / np.sqrt(q)).astype(value.dtype)
    return field


def training_texts(docs: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """Up to ``per_language`` labelled documents of each language, the same ones for the same rows."""
    rows = docs.select(docs[id_col].alias("id"), docs[lang_col].alias("lang"), docs[text_col].alias("t")).filter("lang is not null and t is not null")
    # a hash threshold first leaves about twice the bound of each language, however many rows it has
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = F.from_json(F.lit(json.dumps({x: min(1.0, 2 * per_language / n + 20 / n) for x, n in counts.items()})), "map<string,double>")
    ids = rows.select("id", "lang").withColumn("k", F.xxhash64("id"))
    ids = ids.filter(F.pmod("k", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).withColumn(
        "r", F.row_number().over(Window.partitionBy("lang").orderBy("k", "id"))).filter(F.col("r") <= per_language)
    chosen = {r["id"] for r in ids.select("id").collect()}
    if not chosen:
        return []
    got = rows.filter(F.col("id").isin(list(chosen))).collect()
    best: dict = {}
    for r in sorted(got, key=lambda r: (str(r["id"]), r["lang"], r["t"])):
        best.setdefault((r["id"], r["lang"]), r["t"])
    return [(t, lang) for (_, lang), t in sorted(best.items(), key=lambda x: (str(x[0][0]), x[0][1])) if any(map(word_key, t.split()))]


# ---- prediction -----------------------------------------------------------------------------------------

def judge(texts: list[str | None], cache: Emissions) -> list[tuple[str, float]]:
    """(language, mean posterior) of each whole text."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    field = cache.field
    if not field.labels:
        return out
    todo = []
    for k in sorted(range(len(texts)), key=lambda k: len(texts[k] or "")):
        if texts[k]:
            scores = cache.of(words_of(texts[k]))
            if len(scores):
                todo.append((k, scores))
    at = 0
    while at < len(todo):
        to = at + 1
        while to < len(todo) and (to + 1 - at) * max(len(todo[to][1]), 1) <= CELLS_AT_ONCE:
            to += 1
        part = todo[at:to]
        for (k, _), p in zip(part, forward_backward([s for _, s in part], field)):
            mean = p.mean(0)
            out[k] = field.labels[int(mean.argmax())], float(min(1.0, mean.max()))
        at = to
    return out


def identify(docs: DataFrame, field: Field, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` as a struct ``row``, with the predicted language and its score: the mean
    probability of that label over the text's words.

    A null text or one without a letter is ``und`` with score 0, and so is every text if nothing was learned.
    No rows give no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        field = shared.value  # one object a worker process, and with it one table of words for all its tasks
        cache = vars(field).setdefault("emissions", Emissions(field))
        for texts in batches:
            out, part, size = [], [], 0
            for k, text in enumerate(texts):
                part.append(text)
                size += len(text or "")
                if size >= CHARS_AT_ONCE or k + 1 == len(texts):
                    out += judge(part, cache)
                    part, size = [], 0
            yield pd.DataFrame(out, columns=["lang", "score"])

    judged = F.pandas_udf(predicted, "lang string, score double")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), judged(docs[text_col].cast("string")).alias("x"))
    return rows.select("row", F.col("x.lang").alias(lang_out), F.col("x.score").alias(score_out))


def learn(docs: DataFrame, per_language: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Field:
    """The field fitted to at most ``per_language`` labelled rows of each language in ``docs``."""
    texts = training_texts(docs, per_language, id_col, text_col, lang_col)
    return fit(texts) if texts else Field([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)), np.zeros(0), {})

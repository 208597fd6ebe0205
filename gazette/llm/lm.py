"""Log-bilinear language model, trained with noise-contrastive estimation and scored with full normalisation.

The model's vocabulary is the most frequent words and, for all others, a class by the word's last two bytes;
a word of a class has the add-one share of its count in the class.  The score of id w after the ids h1 (last)
and h2 is (r[h1] C1 + r[h2] C2) . q[w] + b[w].  Every task trains on its own documents, from the same start
(b the log unigram shares), and the parameters are averaged by tokens.  The normalisers of all pairs of
context ids come from batched matrix products, so a token's log-probability is four table look-ups.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.common import written

END = ""  # the token after the last word; words are never empty
COUNTED_AT_ONCE = 200_000


def word_class(word: str, classes: int) -> int:
    return zlib.crc32(word.encode()[-2:]) % classes


# ---- counts ---------------------------------------------------------------------------------------------

def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, c) over all rows of ``docs``, one end token a row, as a table in the shared folder."""
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch["t"]:
                held.update((text or "").encode().lower().split())
                held[b""] += 1
                if len(held) > COUNTED_AT_ONCE:
                    yield pd.DataFrame({"word": [w.decode() for w in held], "c": list(held.values())})
                    held.clear()
        if held:
            yield pd.DataFrame({"word": [w.decode() for w in held], "c": list(held.values())})

    rows = docs.select(docs[text_col].cast("string").alias("t"))
    return written(rows.mapInPandas(counted, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")


@dataclass
class Vocabulary:
    """``common``: the most frequent words with their counts, most frequent first; the first ``listed`` are ids of
    their own, the others go by class.  class_tokens and class_words leave the listed words out."""

    common: list[str]
    counts: np.ndarray
    listed: int
    classes: int
    class_tokens: np.ndarray
    class_words: np.ndarray
    tokens: int
    distinct: int

    @property
    def size(self) -> int:
        return self.listed + self.classes

    def shares(self) -> np.ndarray:
        """Unigram shares of the model's ids, each counted once more than seen."""
        seen = np.r_[self.counts[: self.listed], self.class_tokens] + 1.0
        return seen / seen.sum()

    def ids(self) -> dict[str, int]:
        return {w: k if k < self.listed else self.listed + word_class(w, self.classes) for k, w in enumerate(self.common)}


def vocabulary(counts: DataFrame, listed: int, classes: int, common: int) -> Vocabulary:
    """The vocabulary of (word, c).  A histogram of the counts' logarithms, a few hundred rows at any size, gives the
    least count that at most ``common`` words reach; only these come to the driver.  The end token is always
    listed."""
    step = F.floor(F.log2("c") * 16).cast("int")
    least, held = 1 << 30, 0
    for r in sorted(counts.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"]):
        held += r["count"]
        if held > common:
            break
        least = r["s"]
    found = sorted(((-r["c"], r["word"]) for r in counts.filter((step >= least) | (F.col("word") == END)).collect()))
    ends = sum(-c for c, w in found if w == END)
    found = [(w, -c) for c, w in found if w != END]
    at = min(sum(c >= ends for _, c in found), listed - 1)
    found.insert(at, (END, ends))
    listed = min(listed, len(found))

    by_class = counts.withColumn("g", _class_of(classes)("word")).groupBy("g").agg(F.sum("c"), F.count(F.lit(1))).collect()
    tokens, distinct = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    for g, c, n in by_class:
        tokens[g], distinct[g] = c, n
    total, known = int(tokens.sum()), int(distinct.sum())
    for word, c in found[:listed]:
        g = word_class(word, classes)
        tokens[g] -= c
        distinct[g] -= c > 0
    return Vocabulary([w for w, _ in found], np.array([c for _, c in found], np.int64), listed, classes, tokens, distinct, total, known)


def _class_of(classes: int):
    @F.pandas_udf("int")
    def of(found: pd.Series) -> pd.Series:
        return pd.Series([word_class(w, classes) for w in found], dtype="int32")
    return of


# ---- model ----------------------------------------------------------------------------------------------

def start(vocab: Vocabulary, width: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    n = vocab.size
    return {"r": rng.normal(0, 0.1, (n, width)).astype(np.float32), "q": rng.normal(0, 0.1, (n, width)).astype(np.float32),
            "c": np.stack([np.eye(width), np.eye(width) * 0.5]).astype(np.float32), "b": np.log(vocab.shares()).astype(np.float32)}


def summed(ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Rows added up by id."""
    order = np.argsort(ids, kind="stable")
    at = ids[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    out = np.zeros((n, *rows.shape[1:]), rows.dtype)
    out[at[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Trainer:
    """Noise-contrastive estimation with AdaGrad; one set of noise ids a batch, drawn from the unigram shares."""

    def __init__(self, model: dict[str, np.ndarray], shares: np.ndarray, noise: int, rate: float, seed: int):
        self.p = {k: v.copy() for k, v in model.items()}
        self.squares = {k: np.full(v.shape, 1e-3, np.float32) for k, v in model.items()}
        self.rng, self.noise, self.rate = np.random.default_rng(seed), noise, rate
        self.edges, self.offset = np.cumsum(shares), np.log(noise * shares).astype(np.float32)

    def step(self, w: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> None:
        p, n = self.p, len(self.edges)
        x = np.minimum(np.searchsorted(self.edges, self.rng.random(self.noise)), n - 1)
        r1, r2 = p["r"][h1], p["r"][h2]
        hat = r1 @ p["c"][0] + r2 @ p["c"][1]
        qw, qx = p["q"][w], p["q"][x]
        true = -1 / (1 + np.exp(np.minimum(np.einsum("ij,ij->i", hat, qw) + p["b"][w] - self.offset[w], 60)))
        false = 1 / (1 + np.exp(np.minimum(self.offset[x] - p["b"][x] - hat @ qx.T, 60)))
        up = true[:, None] * qw + false @ qx
        grads = {"q": summed(w, true[:, None] * hat, n), "b": np.bincount(w, true, n).astype(np.float32),
                 "c": np.stack([r1.T @ up, r2.T @ up]),
                 "r": summed(np.r_[h1, h2], np.r_[up @ p["c"][0].T, up @ p["c"][1].T], n)}
        np.add.at(grads["q"], x, false.T @ hat)
        np.add.at(grads["b"], x, false.sum(0))
        for k, g in grads.items():
            self.squares[k] += g * g
            p[k] -= self.rate * g / np.sqrt(self.squares[k])


def context(ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The last id and the one before it, for the ids of texts that each close with ``end``; before a text stand
    ends."""
    h1 = np.r_[end, ids[:-1]]
    h2 = np.r_[end, h1[:-1]]
    return h1, np.where(h1 == end, end, h2)


def train(docs: DataFrame, vocab: Vocabulary, text_col: str, width: int, noise: int, batch: int, rate: float, seed: int) -> dict[str, np.ndarray]:
    """The parameters after one pass over all rows of ``docs``, averaged over tasks by their tokens."""
    spark = docs.sparkSession
    model = start(vocab, width, seed)
    names = list(model)
    shape = {k: v.shape for k, v in model.items()}
    cut = np.cumsum([0, *(v.size for v in model.values())])
    shared = spark.sparkContext.broadcast((model, vocab.shares(), vocab.ids(), vocab.listed, vocab.classes))

    def trained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, shares, ids, listed, classes = shared.value
        known = {w.encode(): k for w, k in ids.items()}
        end, seen = known[b""], 0
        trainer = Trainer(model, shares, noise, rate, seed + 1 + TaskContext.get().partitionId())
        for frame in batches:
            held: list[int] = []
            for k, text in enumerate(frame["t"]):
                found = (text or "").encode().lower().split()
                try:
                    held += [known[w] for w in found]
                except KeyError:
                    held += [known[w] if w in known else listed + zlib.crc32(w[-2:]) % classes for w in found]
                held.append(end)
                if len(held) < 64 * batch and k + 1 < len(frame):
                    continue
                w = np.asarray(held, np.int64)
                h1, h2 = context(w, end)
                for at in range(0, len(w), batch):
                    trainer.step(w[at:at + batch], h1[at:at + batch], h2[at:at + batch])
                seen += len(w)
                held = []
        if seen:
            flat = np.concatenate([trainer.p[k].ravel() for k in names]).astype(float)
            yield pd.DataFrame({"k": np.arange(len(flat)), "v": flat * seen, "n": float(seen)})

    rows = docs.select(docs[text_col].cast("string").alias("t"))
    mean = rows.mapInPandas(trained, "k int, v double, n double").groupBy("k").agg((F.sum("v") / F.sum("n")).alias("v")).toPandas()
    flat = np.zeros(cut[-1], np.float32)
    flat[mean["k"].to_numpy()] = mean["v"].to_numpy()
    return {k: flat[a:b].reshape(shape[k]) for k, a, b in zip(names, cut, cut[1:])} if len(mean) else model


def log_normalisers(model: dict[str, np.ndarray], first: np.ndarray) -> np.ndarray:
    """(len(first), ids): ln Z of the contexts (h1 in ``first``, any h2)."""
    second = model["r"] @ model["c"][1]
    out = []
    for h1 in first:
        s = (model["r"][h1] @ model["c"][0] + second) @ model["q"].T + model["b"]
        top = s.max(1)
        out.append(top + np.log(np.exp(s - top[:, None]).sum(1)))
    return np.asarray(out, np.float32).reshape(len(first), len(second))


@dataclass
class Tables:
    """ln-scores by (h1, w) and (h2, w), and ln Z by (h1, h2)."""

    last: np.ndarray
    before: np.ndarray
    normaliser: np.ndarray

    def log10(self, w: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return (self.last[h1, w] + self.before[h2, w] - self.normaliser[h1, h2]).astype(np.float64) / np.log(10)


def tables(spark: SparkSession, model: dict[str, np.ndarray]) -> Tables:
    n = len(model["b"])
    shared = spark.sparkContext.broadcast(model)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h = batch["id"].to_numpy()
            yield pd.DataFrame({"h": h, "z": list(log_normalisers(shared.value, h))})

    rows = spark.range(0, n, 1, min(n, 32)).mapInPandas(made, "h long, z array<float>").collect()
    z = np.zeros((n, n), np.float32)
    for r in rows:
        z[r["h"]] = r["z"]
    return Tables((model["r"] @ model["c"][0] @ model["q"].T + model["b"]).astype(np.float32),
                  (model["r"] @ model["c"][1] @ model["q"].T).astype(np.float32), z)


# ---- scores ---------------------------------------------------------------------------------------------

def score_texts(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", listed: int = 896,
                classes: int = 128, common: int = 200_000, width: int = 24, noise: int = 48, batch: int = 1024,
                rate: float = 0.1, seed: int = 9) -> DataFrame:
    """(<id_col>, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``, learned from
    all rows where ``training`` holds.

    Tokens are the words after lower-casing A-Z and one end.  base_score: sum of log10((c + 1) / (N + V + 1));
    score: the model's log10 probability.  At most ``common`` most frequent words (a fixed number) are kept in each
    task; the counts of all others are joined.  Null and empty texts are one end token.  Rows that share an
    id are scored each.  Without rows to learn from every count is 0 and the model is uniform.  No rows give
    no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("t"), F.coalesce(training, F.lit(False)).alias("learn"))
    learn = rows.filter("learn")
    counts = word_counts(learn, "t")
    vocab = vocabulary(counts, listed, classes, common)
    model = train(learn, vocab, "t", width, noise, batch, rate, seed) if vocab.tokens else start(vocab, width, seed)
    shared = spark.sparkContext.broadcast((vocab, tables(spark, model)))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab, table = shared.value
        known = {w.encode(): k for k, w in enumerate(vocab.common)}
        ids = np.asarray(list(vocab.ids().values()), np.int64)
        every = vocab.tokens + vocab.distinct + 1.0
        in_class = np.log10(vocab.class_tokens + vocab.class_words + 1.0)
        seen = np.log10(vocab.counts + 1.0)
        own = np.where(np.arange(len(ids)) < vocab.listed, 0.0, seen - in_class[np.maximum(ids - vocab.listed, 0)])
        end = int(known[b""])
        for frame in batches:
            out = []
            for row, key, learned, text in zip(frame["row"], frame["id"], frame["learn"], frame["t"]):
                found = (text or "").encode().lower().split()
                at = np.asarray([known.get(w, -1) for w in found] + [end], np.int64)
                w = ids[at]
                new = np.flatnonzero(at < 0)
                rare = Counter(found[k] for k in new) if len(new) else Counter()
                g = [zlib.crc32(found[k][-2:]) % vocab.classes for k in new]
                w[new] = vocab.listed + np.asarray(g, np.int64) if len(new) else w[new]
                h1, h2 = context(w, end)
                common = at[at >= 0]
                total = table.log10(w, h1, h2).sum() + own[common].sum() - (in_class[g].sum() if len(new) else 0.0)
                out.append((row, key, not learned, len(at), int((vocab.counts[common] > 0).sum()), seen[common].sum() - len(at) * np.log10(every),
                            total, [x.decode() for x in rare], list(rare.values())))
            yield pd.DataFrame(out, columns=["row", "id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "times"])

    part = written(rows.withColumn("id", F.col("id").cast("string")).withColumn("row", F.monotonically_increasing_id()).mapInPandas(
        scored, "row long, id string, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<string>, times array<long>"), "lm-scores")
    rare = part.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", "x.rare", "x.times")
    more = (rare.join(counts, F.col("rare") == F.col("word"), "left").groupBy(F.col("row").alias("row2")).agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("more")))
    whole = part.drop("rare", "times").join(more, F.col("row") == F.col("row2"), "left")
    extra = F.coalesce("more", F.lit(0.0))
    return whole.select(F.col("id").cast(kind).alias(id_col), "held_out", "n_tokens",
                        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
                        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
                        (F.col("base") + extra).alias("base_score"), (F.col("score") + extra).alias("score"))

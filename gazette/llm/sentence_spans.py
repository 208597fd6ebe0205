"""Substring dedup by sliding sentence spans.

From every sentence a run starts: the fewest consecutive sentences, ``sentences`` at least, that hold
``words`` words.  Runs are hashed (128 bits) and joined over all documents; every sentence that a non-first
repeated run covers is removed.  First is the run in the document with the smallest id, and in it the first.

A sentence of over 16 words counts as several: it is cut at commas and other scripts' stops, and what is still
longer at words chosen by their content; so is a word of over 32 letters at letters.  Parts have at most 16 words, and
the cuts depend on the words nearby only: texts that share over 48 words share a run, wherever sentences end.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.common import written

BREAK = re.compile(r"((?<=[.!?])[ \t]+|\s*\n\s*)")
PAUSE = re.compile(r"[,;:。！？，、；：।؟،؛](\s*)")
WORD = re.compile(r"\S+")
LONGEST, LONGEST_WORD = 16, 32  # words of a part, letters of a word
LAST = (1 << 63) - 1  # stands for a null id, which ranks last


def chosen(keys: list[int]) -> list[int]:
    """The places of the smallest key (of equals, the last) of every ``LONGEST`` neighbours: at most so far apart, and
    the same ones in equal stretches."""
    out, best = [], -1
    for at in range(LONGEST - 1, len(keys)):
        if best <= at - LONGEST:
            best = at - LONGEST + 1
            for k in range(best + 1, at + 1):
                if keys[k] <= keys[best]:
                    best = k
        elif keys[at] <= keys[best]:
            best = at
        if not out or out[-1] != best:
            out.append(best)
    return out


def over_long(sentence: str) -> bool:
    if len(sentence) <= LONGEST_WORD:
        return False
    words = sentence.split()
    return len(words) > LONGEST or max(map(len, words), default=0) > LONGEST_WORD


def cuts(piece: str) -> list[tuple[int, int]]:
    """Where the parts of ``piece`` end and the next ones begin."""
    found = [m.span() for m in WORD.finditer(piece)]
    out = []
    if len(found) > LONGEST:
        keys = [zlib.crc32(piece[a:b].encode().lower()) for a, b in found]
        out = [(found[k][1], found[k + 1][0]) for k in chosen(keys) if k + 1 < len(found)]
    for a, b in found:
        if b - a > LONGEST_WORD:
            keys = [zlib.crc32(piece[k:k + 2].encode().lower()) for k in range(a, b - 1)]
            out += [(a + k + 1, a + k + 1) for k in chosen(keys)]
    return sorted(out)


def split(text: str) -> tuple[list[str], list[str]]:
    """Sentences, long ones in parts, and what follows each; together they are the text."""
    found = BREAK.split(text)
    parts, seps = [], []
    for sentence, after in zip(found[::2], [*found[1::2], ""]):
        if not over_long(sentence):
            parts.append(sentence)
            seps.append(after)
            continue
        pieces, begin = [], 0
        for m in PAUSE.finditer(sentence):
            if m[1] or m[0] not in ",;:":
                pieces.append((sentence[begin:m.start(1)], m[1]))
                begin = m.end()
        for piece, pause in [*pieces, (sentence[begin:], after)]:
            at = 0
            for end, begin in cuts(piece) if over_long(piece) else ():
                parts.append(piece[at:end])
                seps.append(piece[end:begin])
                at = begin
            parts.append(piece[at:])
            seps.append(pause)
    return parts, seps


def runs(sentences: list[str], least: int, words: int) -> list[tuple[int, int, int]]:
    """(first sentence, end, hash) of the run from every sentence that the text is long enough for.  Sentences
    without words belong to no run's count."""
    import xxhash

    real = [(k, s) for k, s in enumerate(" ".join(s.split()).encode().lower() for s in sentences) if s]  # bytes: A-Z only
    sizes = [s.count(b" ") + 1 for _, s in real]
    out, end, total = [], 0, 0
    for at in range(len(real)):
        while end < len(real) and (end - at < least or total < words):
            total += sizes[end]
            end += 1
        if end - at < least or total < words:
            break
        h = xxhash.xxh3_128_intdigest(b"\n".join([s for _, s in real[at:end]]))
        out.append((real[at][0], real[end - 1][0] + 1, h))
        total -= sizes[at]
    return out


def halves(h: int) -> tuple[int, int]:
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def remove_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: int = 2,
                 words: int = 12) -> DataFrame:
    """(<id_col>, text, n_sentences, removed_sentences, repeats_of), one row per row of ``docs``: the text without the
    sentences that a non-first repeated run covers, and the ids (ascending) of the documents that had them first.

    A part of a long sentence counts as a sentence.  A null text stays null, an empty one empty; texts too short for a
    run stay as they are.  Ids are integers; a null id ranks last and is not listed in repeats_of.  Rows that share an
    id (or have none) are documents of their own, ranked by their text's hash; of equal rows one is first.  No rows
    give no rows.  Other columns are ignored.
    """
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            a, b, within = [], [], []
            for t in texts:
                every = [h for _, _, h in runs(split(t)[0], sentences, words)] if t else []
                own = set(every)
                pair = np.array([halves(h) for h in own], np.int64).reshape(-1, 2)
                a.append(pair[:, 0])
                b.append(pair[:, 1])
                within.append(len(own) < len(every))
            yield pd.DataFrame({"a": a, "b": b, "within": within})

    made = F.pandas_udf(hashed, "a array<long>, b array<long>, within boolean")
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("t")).select(
        "id", "t", F.coalesce("id", F.lit(LAST)).alias("doc"), F.xxhash64("t").alias("rank"))
    found = written(rows.select("doc", "rank", made("t").alias("h")).select("doc", "rank", "h.*"), "spans")
    spans = found.select("doc", "rank", F.explode(F.arrays_zip("a", "b")).alias("h")).select("doc", "rank", "h.a", "h.b")
    order = Window.partitionBy("a", "b").orderBy("doc", "rank")
    again = spans.select("*", F.first("doc").over(order).alias("first"), F.first("rank").over(order).alias("best")).filter("doc <> first or rank <> best")
    within = found.filter("within").select("doc", "rank", F.lit(None).cast("long").alias("first"), F.lit(None).cast("struct<a:bigint,b:bigint>").alias("h"))
    marked = again.select("doc", "rank", F.when(F.col("first") < LAST, F.col("first")).alias("first"), F.struct("a", "b").alias("h")).union(within).groupBy(
        F.col("doc").alias("doc2"), F.col("rank").alias("rank2")).agg(F.collect_set("h").alias("spans"), F.collect_set("first").alias("of"))

    @F.pandas_udf("text string, n_sentences long, removed_sentences long, own boolean")
    def cleaned(texts: pd.Series, spans: pd.Series, copies: pd.Series) -> pd.DataFrame:
        out = []
        for t, known, copy in zip(texts, spans, copies):
            if not t:
                out.append((t, 0, 0, False))
                continue
            parts, seps = split(t)
            real = sum(not p.isspace() for p in parts if p)
            if known is None and not copy:  # no run of the document occurs twice, in it or elsewhere before
                out.append((t, real, 0, False))
                continue
            gone, seen, own = {(x["a"], x["b"]) for x in (known if known is not None else ())}, set(), False
            covered = np.zeros(len(parts) + 1, np.int64)
            for at, end, h in runs(parts, sentences, words):
                new = h not in seen and halves(h) not in gone
                if copy or not new:
                    covered[at] += 1
                    covered[end] -= 1
                own |= bool(copy and new)  # the first of the equal rows had it first
                seen.add(h)
            drop = (np.cumsum(covered[:-1]) > 0) & np.array([bool(p.strip()) for p in parts])
            text = "".join(p + s for p, s, d in zip(parts, seps, drop) if not d) if drop.any() else t
            out.append((text, real, int(drop.sum()), own))
        return pd.DataFrame(out, columns=["text", "n_sentences", "removed_sentences", "own"])

    copies = Window.partitionBy("doc", "rank").orderBy("doc")
    rows = rows.withColumn("copy", F.row_number().over(copies) > 1)
    joined = rows.join(marked, (F.col("doc") == F.col("doc2")) & (F.col("rank") == F.col("rank2")), "left")
    out = joined.select("id", cleaned("t", "spans", "copy").alias("x"), F.coalesce("of", F.array().cast("array<long>")).alias("of"))
    of = F.when(F.col("x.own") & F.col("id").isNotNull(), F.array_union("of", F.array("id"))).otherwise(F.col("of"))
    return out.select(F.col("id").alias(id_col), F.col("x.text").alias("text"), "x.n_sentences", "x.removed_sentences", F.sort_array(of).alias("repeats_of"))

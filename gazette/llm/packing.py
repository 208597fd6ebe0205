"""Harmonic packing of tokenised documents into fixed-length sequences.

A piece of length l is of class j when j such pieces fit a sequence: l <= capacity / j.  A document is cut
so that every piece nearly fills its share (within ``slack`` of the capacity for all j together).  Each
worker fills its bins of class j with exactly j pieces and needs no word from the others; what is left over,
under j pieces a class and worker, is strung together by class and filled the same way.  The last under j
pieces of each class, at most about 21,000 pieces at any input size, are packed first-fit by falling length.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.common import small_side, written

CACHED_WORDS = 600_000
KEPT_WORDS = 250_000  # of a full table, and after a task: the first ones, among them the frequent ones
LONGEST_CACHED = 64
STEMS_AT_ONCE = 10_000
CHARS_AT_ONCE = 1 << 22
MARKS = ".,;:!?$%&#*"
LATIN_END = "\u0250"  # letters before it are never changed by Unicode normalisation
PIECES_PER_WORKER = 20_000
PIECE = "id string, start long, length long, ids_crc32 long, doc_tokens long, share int"
SALTS = 1024  # equal pieces of one id, or of none, are dealt over as many hashes


def cuts(tokens: int, capacity: int, slack: int) -> list[tuple[int, int, int]]:
    """(start, length, j) of the pieces of a document of ``tokens`` tokens."""
    out, at = [], 0
    while at < tokens:
        left = tokens - at
        j = max(1, capacity // left)
        if left >= capacity:
            size = capacity
        elif capacity - j * left <= slack:
            size = left
        else:
            j += 1
            size = capacity // j
        out.append((at, size, j))
        at += size
    return out


def kept(table: dict[str, bytes]) -> dict[str, bytes]:
    return dict(itertools.islice(table.items(), KEPT_WORDS))


class WordIds:
    """Token ids as little-endian uint32 bytes.  The tokenizer drops white space and lets no token span it, so ids
    are looked up a word (between blanks or line ends) at a time.  A word new to the table is cut into a stem and closing
    punctuation, which are split before anything else; stems of Latin letters only are encoded together, past the normalising
    and splitting that leave them as they are (their ends show by the vocabulary's word-end suffix), all others by the whole tokenizer."""

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.letters.get_vocab()
        suffix = self.letters.model.end_of_word_suffix
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # the ids that end a word
        self.closes[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}

    @staticmethod
    def stem(word: str) -> tuple[str, str]:
        end = ""
        if not word.isalpha():
            cut = word.rstrip(MARKS)
            if cut and cut[-1].lower().isalnum():
                word, end = cut, word[len(cut):]
        low = word.lower()
        return (low if low.isalpha() and (low.isascii() or max(low) < LATIN_END) else word), end

    def learn(self, words: set[str]) -> None:
        """Adds words that the table lacks."""
        new = list(words)
        cut = [self.stem(w) for w in new]
        need = set().union(*cut).difference(self.stems)
        plain = [s for s in need if s.isalpha() and (s.isascii() or max(s) < LATIN_END) and s.islower()]
        for at in range(0, len(plain), STEMS_AT_ONCE):
            part = plain[at:at + STEMS_AT_ONCE]
            ids = np.asarray(self.letters.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            edges = [0, *(4 * np.flatnonzero(self.closes[ids]) + 4).tolist()]
            raw = ids.tobytes()
            self.stems.update(zip(part, (raw[s:e] for s, e in zip(edges, edges[1:])), strict=True))
        rest = list(need.difference(plain))
        for s, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self.stems[s] = np.asarray(found.ids, "<u4").tobytes()
        stems = self.stems
        self.known.update(zip(new, [stems[s] + stems[end] if end else stems[s] for s, end in cut]))

    def ids(self, texts: list[str]) -> list[bytes]:
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > CACHED_WORDS:
            self.known = kept(self.known)
        if len(self.stems) > CACHED_WORDS:
            self.stems = kept(self.stems)
        new = set(words).difference(self.known)
        long = {w: self.direct(w) for w in new if len(w) > LONGEST_CACHED}
        self.learn(new.difference(long))
        known = self.known
        found = [known[w] if w in known else long[w] for w in words]
        # one look-up a distinct word; each word's ids are then copied from its place among the distinct ones' ids
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = coded.indices.to_numpy()
        n = sizes[at]
        ends = np.cumsum(n)
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat((np.cumsum(sizes) - sizes)[at] - ends + n, n) + np.arange(ends[-1])]
        edges = np.concatenate([[0], ends])[split.offsets.to_numpy()].tolist()
        return [ids[s:e].tobytes() for s, e in zip(edges, edges[1:])]

    def rest(self) -> None:
        """Gives back memory between tasks."""
        self.known, self.stems = kept(self.known), kept(self.stems)

    def direct(self, word: str) -> bytes:
        return np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()


@functools.cache
def word_ids(path: str) -> WordIds:
    """One table a worker process, for all its tasks."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, end_id: int, capacity: int,
           slack: int) -> DataFrame:
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_ids(tokenizer_path)
        end = np.asarray([end_id], "<u4").tobytes()
        salt = itertools.cycle(range(SALTS))
        for batch in batches:
            out, keys, texts, size = [], [], [], 0
            for k, (key, text) in enumerate(zip(batch["id"], batch["t"])):
                keys.append(key)
                texts.append(text or "")
                size += len(texts[-1])
                if size < CHARS_AT_ONCE and k + 1 < len(batch):
                    continue
                for key, ids in zip(keys, words.ids(texts)):
                    ids += end
                    n = len(ids) // 4
                    out += [(key, s, m, zlib.crc32(ids[4 * s:4 * (s + m)]), n, j, next(salt)) for s, m, j in cuts(n, capacity, slack)]
                keys, texts, size = [], [], 0
            yield pd.DataFrame(out, columns=["id", "start", "length", "ids_crc32", "doc_tokens", "share", "salt"])
        words.rest()

    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].cast("string").alias("t"))
    return rows.mapInPandas(made, PIECE + ", salt int")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
         capacity: int = 4096, slack: int = 64) -> DataFrame:
    """One row per piece: <id_col>, start, length, ids_crc32, doc_tokens, sequence_id, offset, share (its class;
    0 for the last few).  Pieces of a sequence are gapless from offset 0.

    Null and empty texts are the end id alone.  Rows that share an id are documents of their own.  No rows give
    no rows.  Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    made = written(pieces(docs, tokenizer_path, id_col, text_col, end_id, capacity, slack), "pieces")
    workers = max(1, min(made.count() // PIECES_PER_WORKER, (1 << 18) - 2))
    made = made.withColumn("worker", F.pmod(F.xxhash64("id", "start", "ids_crc32", "salt"), F.lit(workers)).cast("int")).drop("salt")

    own = Window.partitionBy("share", "worker")
    ranked = made.withColumn("r", F.row_number().over(own.orderBy("id", "start", "ids_crc32")) - 1)
    counts = made.groupBy("share", "worker").agg(F.count(F.lit(1)).alias("n")).withColumn("left", F.col("n") % F.col("share"))
    before = Window.partitionBy("share").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col("share").alias("share2"), F.col("worker").alias("worker2"), (F.col("n") - F.col("left")).alias("full"),
        F.coalesce(F.sum("left").over(before), F.lit(0)).alias("left_before"),
        F.sum("left").over(Window.partitionBy("share")).alias("left_all"))
    counts = small_side(counts, workers * 128)
    at = ranked.join(counts, (F.col("share") == F.col("share2")) & (F.col("worker") == F.col("worker2")))
    alone = F.col("r") < F.col("full")
    pooled = F.col("left_before") + F.col("r") - F.col("full")
    at = at.select(
        "id", "start", "length", "ids_crc32", "doc_tokens", "share",
        F.when(alone, F.col("worker")).otherwise(-1).alias("worker"),
        F.when(alone, F.col("r")).otherwise(pooled).cast("long").alias("r"),
        (~alone & (pooled >= F.col("left_all") - F.col("left_all") % F.col("share"))).alias("last"))

    inside = Window.partitionBy("share", "worker", "bin").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    full = (at.filter("not last").withColumn("bin", F.floor(F.col("r") / F.col("share")))
            .withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
            .withColumn("sequence_id", F.shiftleft(F.col("share").cast("long"), 50)
                        + F.shiftleft((F.col("worker") + 1).cast("long"), 32) + F.col("bin")))

    def first_fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "id", "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        room: list[int] = []
        seq, off = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for k, size in enumerate(rows["length"]):
            free = np.flatnonzero(np.asarray(room) >= size) if room else ()
            b = int(free[0]) if len(free) else len(room)
            if b == len(room):
                room.append(capacity)
            seq[k], off[k] = b, capacity - room[b]
            room[b] -= size
        return rows.drop(columns=["worker", "r", "last", "one"]).assign(share=np.int32(0), sequence_id=seq, offset=off)

    out = PIECE + ", sequence_id long, offset long"
    last = at.filter("last").withColumn("one", F.lit(0)).groupBy("one").applyInPandas(first_fit, out)
    names = [c.split()[0] for c in out.split(", ")]
    both = full.select(*names).union(last.select(*names))
    return both.select(F.col("id").cast(kind).alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
                       F.col("sequence_id").cast("long").alias("sequence_id"),
                       F.col("offset").cast("long").alias("offset"), "share")

"""Alignment of two tokenizers' tokens over the same text.

Tokenizer A (byte-level BPE, tokenizers library) reads a space and the text, tokenizer B (BPE with byte fallback, sentencepiece)
the text, before which it puts a space itself.  The character offsets of A's tokens and the byte spans that sentencepiece
reports for B's are coarse cuts: they tell which stretch of the text a token belongs to, but tokens within a
character share its offsets, and byte-fallback tokens have empty spans.  Inside a stretch the decoded bytes of
the tokens refine them to byte offsets.  Offsets at which a token of A and one of B both end cut the tokens into groups.

A stretch is white space and the word behind it, or the marks behind a word.  Neither tokenizer has a token that reaches from a word
into a blank, tab, line end or mark behind it, so each stretch is encoded once a worker and looked up when it comes again.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import written

LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?&%$#*"
# A stretch starts at a blank, tab or line end behind anything else, or at a mark behind a letter; other white space does not cut.
STRETCH = re.compile(rf"\s*[{LETTERS}]++(?=[{MARKS}])|\s*\S+(?:[^\S \t\n]\s*\S*)*|\s+")
OPEN_END = re.compile(r"\s\Z")  # what follows could change such a stretch's tokens
BLANK = "▁"
CACHED = 400_000  # stretches a worker keeps
KEPT = 150_000  # of a full table: the first ones, among them the frequent ones
CHARS_AT_ONCE = 200_000
BLOCK_CHARS = 2_000_000
B_BITS = 16
MADE = ("block long, id string, n_a long, n_b long, n_groups long, n_links long, groups string, links binary, "
        "pairs array<long>, counts array<long>")


def byte_level_bytes(token: str) -> bytes:
    """The bytes of a byte-level token: printable bytes are written as their own character, the others from U+0100 on."""
    return bytes(map(byte_level_table().__getitem__, token))


@functools.cache
def byte_level_table() -> dict[str, int]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)).difference(plain)))}


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        import os

        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        special = {k for k, t in self.a.get_added_tokens_decoder().items() if t.special}
        self.a_bytes = {k: t.encode() if k in special else byte_level_bytes(t) for t, k in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(BLANK, " ").encode() for k, p in enumerate(pieces)]
        if any(re.search(rf"[^{BLANK}]{BLANK}|[ \t\n]|[{LETTERS}][{MARKS}]", p) for p in pieces):
            raise ValueError(f"{b_path}: a piece reaches over the end of a word")
        if len(pieces) > 1 << B_BITS:
            raise ValueError(f"{b_path}: more than {1 << B_BITS} pieces")
        self.a_sizes = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_sizes[list(self.a_bytes)] = [len(t) for t in self.a_bytes.values()]
        self.b_sizes = np.asarray([len(t) for t in self.b_bytes])
        self.b_is_byte = np.asarray([self.b.is_byte(k) for k in range(len(pieces))])
        self.b_spelled = 2 * len(self.a_sizes)
        self.spelled = [f"{k}{sign}" for n, signs in ((len(self.a_sizes), ",|"), (len(pieces), ",;")) for k in range(n) for sign in signs]
        self.known: dict[str, int] = {}
        self.sizes = np.zeros((1, 3), np.int64)  # by stretch: n_a, n_b, n_groups; 0 if the bytes differ
        self.groups: list[str] = []
        self.links: list[bytes] = []

    def shrink(self) -> None:
        keep = list(itertools.islice(self.known.items(), KEPT))
        rows = [k for _, k in keep]
        self.sizes, self.groups, self.links = self.sizes[rows], [self.groups[k] for k in rows], [self.links[k] for k in rows]
        self.known = {stretch: k for k, (stretch, _) in enumerate(keep)}

    def a_tokens(self, text: str, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """A's ids and the byte at which each token ends: that of its last character, unless the next token shares it."""
        encoding = self.a.encode(text, add_special_tokens=False)
        ids = np.asarray(encoding.ids, np.int64)
        spans = np.asarray(encoding.offsets, np.int64).reshape(-1, 2)
        if len(data) != len(text):
            points = np.frombuffer(text.encode("utf-32-le"), "<u4")
            width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            spans = np.concatenate([[0], np.cumsum(width)])[spans]
        within = np.append(spans[1:, 0], len(data)) < spans[:, 1]
        return ids, np.where(within, np.cumsum(self.a_sizes[ids]), spans[:, 1])

    def b_tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """B's ids and the byte at which each token ends: that of its span, unless it is a byte of a character.  A
        letter of our own takes the space that B adds."""
        proto = self.b.encode("x" + text, return_type="proto")
        found = np.asarray([(piece.id, piece.end) for piece in proto.pieces if piece.end > 1], np.int64).reshape(-1, 2)
        ids = found[:, 0]
        return ids, np.where(self.b_is_byte[ids], np.cumsum(self.b_sizes[ids]), found[:, 1] - 1)

    def learn(self, stretches: list[str]) -> None:
        text = "".join(stretches)
        data = text.encode("utf-8")
        (a, a_end), (b, b_end) = self.a_tokens(text, data), self.b_tokens(text)
        if b"".join([self.a_bytes[k] for k in a.tolist()]) != data or b"".join([self.b_bytes[k] for k in b.tolist()]) != data:
            if len(stretches) == 1:
                self.remember(stretches, np.zeros((1, 3), np.int64), [""], [b""])
            for part in (stretches[:len(stretches) // 2], stretches[len(stretches) // 2:]) if len(stretches) > 1 else ():
                self.learn(part)
            return
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
        a_last, b_last = np.diff(a_group, append=len(cuts)) > 0, np.diff(b_group, append=len(cuts)) > 0
        links = a[a_last] << B_BITS | b[b_last]
        a_upto, b_upto = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1  # tokens up to each cut
        order = np.empty(len(a) + len(b), np.int64)  # spelled group by group, A's tokens first
        order[np.arange(len(a)) + np.concatenate([[0], b_upto])[a_group]] = a * 2 + a_last
        order[np.arange(len(b)) + a_upto[b_group]] = self.b_spelled + b * 2 + b_last
        spelled = [self.spelled[k] for k in order.tolist()]
        ends = np.cumsum([len(s.encode("utf-8")) for s in stretches]) if len(data) != len(text) else np.cumsum([len(s) for s in stretches])
        edge = np.searchsorted(cuts, ends) + 1
        a_at, b_at = a_upto[edge - 1], b_upto[edge - 1]
        raw = links.astype(np.uint64).tobytes()
        upto, byte = [0, *(a_at + b_at).tolist()], [0, *(edge * 8).tolist()]
        self.remember(stretches, np.diff(np.stack([a_at, b_at, edge], 1), axis=0, prepend=0),
                      ["".join(spelled[i:j])[:-1] for i, j in itertools.pairwise(upto)], [raw[i:j] for i, j in itertools.pairwise(byte)])

    def remember(self, stretches: list[str], sizes: np.ndarray, groups: list[str], links: list[bytes]) -> None:
        n = len(self.groups)
        self.known.update(zip(stretches, range(n, n + len(stretches))))
        self.groups += groups
        self.links += links
        while len(self.sizes) < len(self.groups):
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.sizes[n:len(self.groups)] = sizes

    def stretches(self, texts: list[str]) -> list[list[str]]:
        """The stretches of a space and each text; afterwards all are known."""
        split = [STRETCH.findall(" " + t) if t else [] for t in texts]
        if len(self.known) > CACHED:
            self.shrink()
        new, chars = [], 0
        for stretch in set().union(*split).difference(self.known):
            if BLANK in stretch:  # B gives it back as a space
                self.remember([stretch], np.zeros((1, 3), np.int64), [""], [b""])
                continue
            if OPEN_END.search(stretch):
                self.learn([stretch])
                continue
            if not stretch[0].isspace():
                new.append(" a")  # marks follow a letter
            new.append(stretch)
            chars += len(stretch)
            if chars > CHARS_AT_ONCE:
                self.learn(new)
                new, chars = [], 0
        if new:
            self.learn(new)
        return split

    def align(self, texts: list[str], digest: bool) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """n_a, n_b, n_groups, groups (or their digest) and links of each text."""
        split = self.stretches(texts)
        known, groups, links = self.known, self.groups, self.links
        for stretches in split:
            rows = [known[s] for s in stretches]
            sizes = self.sizes[rows]
            if not rows or not sizes[:, 0].all():
                yield 0, 0, 0, "", np.zeros(0, np.uint64)
                continue
            spelled = ";".join([groups[k] for k in rows])
            yield (*sizes.sum(0).tolist(), hashlib.sha256(spelled.encode()).hexdigest() if digest else spelled,
                   np.frombuffer(b"".join([links[k] for k in rows]), np.uint64))


@functools.cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """One table a worker process, for all its tasks."""
    return Aligner(a_path, b_path)


def packed(codes: np.ndarray) -> bytes:
    """Sorted codes as compressed differences; their order does not matter."""
    return zlib.compress(np.diff(np.sort(codes), prepend=0).astype("<u4").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<u4"), dtype=np.int64)


def align_tokens(docs: DataFrame, a_path: str, b_path: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: <id_col>, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``groups`` spells the groups in order, A's ids | B's ids, or is the SHA-256 of that (``digest``); '' without tokens.  A link is a pair
    of tokens of A and B that end together; its count is that of its ids over all documents, and n_best counts the links
    whose count is the highest that their B id has.

    Texts that are null or empty, and texts that a tokenizer's bytes do not give back, have no tokens.  Rows are judged on
    their own; repeated or null ids are carried along.  No rows give no rows.  Other columns are ignored.

    Documents are aligned in blocks of about two million characters (or one longer text).  A block's distinct pairs with their
    numbers are what is shuffled and counted; the counts return to the block, never to single documents.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def block_rows(block: int, ids: list, rows: list) -> pd.DataFrame:
        pairs, codes, counts = np.unique(np.concatenate([r[4] for r in rows]), return_inverse=True, return_counts=True)
        by_count = np.argsort(-counts, kind="stable")  # frequent pairs get small codes
        rank = np.empty(len(pairs), np.int64)
        rank[by_count] = np.arange(len(pairs))
        codes = rank[codes]
        edges = np.cumsum([0] + [len(r[4]) for r in rows])
        out = [(block, i, *r[:3], len(r[4]), r[3], packed(codes[s:e]), None, None) for i, r, s, e in zip(ids, rows, edges, edges[1:])]
        out.append((block, None, 0, 0, 0, 0, "", None, pairs[by_count].astype(np.int64), counts[by_count].astype(np.int64)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in MADE.split(", ")])

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = aligner(a_path, b_path)
        block = TaskContext.get().partitionId() << 32
        ids, rows, held = [], [], 0
        waiting_ids, waiting, chars = [], [], 0
        for batch in batches:
            for k, (key, text) in enumerate(zip(batch["id"], batch["t"])):
                waiting_ids.append(key)
                waiting.append(text or "")
                chars += len(waiting[-1])
                if chars < CHARS_AT_ONCE and k + 1 < len(batch):
                    continue
                rows += tool.align(waiting, digest)
                ids += waiting_ids
                held += chars
                waiting_ids, waiting, chars = [], [], 0
                if held >= BLOCK_CHARS:
                    yield block_rows(block, ids, rows)
                    block += 1
                    ids, rows, held = [], [], 0
        if ids:
            yield block_rows(block, ids, rows)

    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].cast("string").alias("t"))
    blocks = written(rows.mapInPandas(made, MADE), "aligned")
    b_id = F.col("pair").bitwiseAND((1 << B_BITS) - 1)
    pairs = blocks.filter("pairs is not null").select(
        F.col("block").alias("of"), F.posexplode(F.arrays_zip("pairs", "counts")).alias("code", "p")).select(
        "of", "code", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", b_id)
    most = totals.groupBy("b").agg(F.max("total").alias("most"))  # at most one row for each id of B
    scored = totals.join(F.broadcast(most), "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    back = pairs.select("of", "code", "pair").join(scored, "pair").select("of", "code", "total", "best")

    def summed(docs: pd.DataFrame, scores: pd.DataFrame) -> pd.DataFrame:
        total, best = np.zeros(len(scores), np.int64), np.zeros(len(scores), np.int64)
        total[scores["code"]], best[scores["code"]] = scores["total"], scores["best"]
        codes = [unpacked(d) for d in docs["links"]]
        return docs.drop(columns=["block", "links"]).assign(
            n_best=[int(best[c].sum()) for c in codes], count_sum=[int(total[c].sum()) for c in codes])

    out = "id string, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"
    texts = blocks.filter("pairs is null").select("block", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "links")
    found = texts.groupBy("block").cogroup(back.groupBy("of")).applyInPandas(summed, out)
    return found.select(F.col("id").cast(kind).alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")

"""Periodic runs of words, found by block convolution.

At each dyadic scale b the words of many texts are cut into aligned blocks of b words.  For a block and the window of 2 b words
that starts b behind it, the sums of squared differences at all shifts follow from one cyclic convolution, computed exactly
by a number-theoretic transform modulo a prime.  A sum of zero modulo the prime marks an occurrence of the block
at a distance q with b <= q < 2 b; the distance seeds an extension, which compares the words themselves.  A stretch of period q
and length 4 q or more holds such a block with its window, so no run is missed.  A block whose window lies within a run of
a smaller period can only find multiples of that period, so it is left out of the larger scales.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS_AT_ONCE = 1 << 18
CELLS_AT_ONCE = 1 << 16
RUNS = "array<struct<start:long,length:long,period:long>>"
FERMAT = 65537
FERMAT_CELLS = 65536  # its longest transform
LARGE_PRIME = 998244353  # 119 * 2**23 + 1, for longer ones
ROOT = 3  # a primitive root of both


def reduced(x: np.ndarray, prime: int) -> np.ndarray:
    """x modulo the prime; for the Fermat prime only near it, in a fourth of the time (2**16 is -1)."""
    if prime == FERMAT:
        return (x & 0xFFFF) - (x >> 16)
    return x % prime


@functools.cache
def roots(half: int, prime: int, inverse: bool) -> np.ndarray:
    """The powers of a root of unity of order 2 * half."""
    w = pow(ROOT, (prime - 1) // (2 * half), prime)
    if inverse:
        w = pow(w, prime - 2, prime)
    out = np.ones(1, np.int64)
    while len(out) < half:
        out = np.concatenate([out, out * pow(w, len(out), prime) % prime])
    return out[:, None]


def forward(x: np.ndarray, prime: int) -> np.ndarray:
    """Transforms the first axis; the result is in bit-reversed order."""
    n, m = x.shape
    half = n // 2
    while half:
        y = x.reshape(n // (2 * half), 2, half, m)
        low, high = y[:, 0], y[:, 1]
        x = np.empty_like(y)
        x[:, 0] = low + high if prime == FERMAT else reduced(low + high, prime)
        x[:, 1] = reduced((low - high) * roots(half, prime, False), prime)
        x = x.reshape(n, m)
        half //= 2
    return reduced(x, prime)


def backward(x: np.ndarray, prime: int) -> np.ndarray:
    """The inverse of ``forward`` up to the factor n."""
    n, m = x.shape
    half = 1
    while half < n:
        y = x.reshape(n // (2 * half), 2, half, m)
        low, high = y[:, 0], reduced(y[:, 1] * roots(half, prime, True), prime)
        x = np.empty_like(y)
        x[:, 0] = low + high if prime == FERMAT else reduced(low + high, prime)
        x[:, 1] = low - high if prime == FERMAT else reduced(low - high, prime)
        x = x.reshape(n, m)
        half *= 2
    return x


def occurrences(values: np.ndarray, blocks: np.ndarray, size: int, prime: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) pairs, size <= distance < 2 * size, at which a block's squared differences sum to zero mod prime."""
    found, at_once, shifts = [], max(1, CELLS_AT_ONCE // (2 * size)), np.arange(size)[:, None]
    squares = np.concatenate([[0], np.cumsum(values * values % prime)])
    for k in range(0, len(blocks), at_once):
        part = blocks[k:k + at_once]
        window = values[part + size + np.arange(2 * size)[:, None]]
        turned = np.zeros_like(window)  # cell -t holds word t of the block
        turned[0] = values[part]
        turned[:size:-1] = values[part + shifts[1:]]
        product = backward(reduced(forward(turned, prime) * forward(window, prime), prime), prime)[:size]
        behind = part + size + shifts
        sums = reduced(squares[behind + size] - squares[behind] + (squares[part + size] - squares[part]), prime)
        shift, b = np.nonzero((sums * (2 * size) - 2 * product) % prime == 0)  # the transforms bring a factor of 2 * size
        found.append((part[b], shift + size))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def matched(words: np.ndarray, at: int, period: int, low: int, high: int) -> tuple[int, int]:
    """The largest [s, e) around ``at``, low <= s, e + period <= high, in which words[i] == words[i + period]."""
    s, step = at, 32
    while s > low:
        first = max(low, s - step)
        apart = np.flatnonzero(words[first:s] != words[first + period:s + period])
        if len(apart):
            s = first + int(apart[-1]) + 1
            break
        s, step = first, 2 * step
    e, step = at, 32
    while e < high - period:
        last = min(high - period, e + step)
        apart = np.flatnonzero(words[e:last] != words[e + period:last + period])
        if len(apart):
            e += int(apart[0])
            break
        e, step = last, 2 * step
    return s, e


def find_runs(words: np.ndarray, edges: np.ndarray, repeats: int = 4, shortest: int = 6) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text, by start and period.

    ``words`` holds the word numbers of all texts, text k from edges[k] to edges[k + 1].  A run is a maximal stretch with
    smallest period q and a length of at least max(shortest, repeats * q); repeats is 4 or more."""
    found: list[dict[tuple[int, int], int]] = [{} for _ in edges[:-1]]
    lengths = np.diff(edges)
    longest = int(lengths.max(initial=0))
    text = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.zeros(len(words), np.int64)  # the end of the longest run known to hold a word
    size = 1
    while 4 * size <= longest:
        prime = FERMAT if 2 * size <= FERMAT_CELLS else LARGE_PRIME
        blocks = np.arange(0, len(words) - 3 * size + 1, size)
        blocks = blocks[(text[blocks] == text[blocks + 3 * size - 1]) & (lengths[text[blocks]] >= 4 * size) & (inside[blocks] < blocks + 3 * size)]
        if len(blocks):
            values = (words * 40503 + 1) % prime
            at, period = occurrences(values, blocks, size, prime)
            order = np.lexsort((at, period, text[at]))
            last = (-1, -1, 0)
            for j, q in zip(at[order].tolist(), period[order].tolist()):
                k = int(text[j])
                if (k, q) == last[:2] and j + size <= last[2] or inside[j] >= j + q + size:
                    continue
                s, e = matched(words, j, q, int(edges[k]), int(edges[k + 1]))
                if e < j + size:
                    continue  # equal modulo the prime only
                last = (k, q, e)
                if e + q - s >= max(shortest, repeats * q) and (s, e + q) not in found[k]:
                    found[k][s, e + q] = q
                    inside[s:e + q] = np.maximum(inside[s:e + q], e + q)
        size *= 2
    return [sorted((s - int(edges[k]), e - s, q) for (s, e), q in runs.items()) for k, runs in enumerate(found)]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run repeats (all but those behind a run's first period), joined by one space."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period:start + length] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return b" ".join(words).decode("utf-8")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: int = 4, shortest: int = 6) -> DataFrame:
    """One row per document: <id_col>, n_words, runs (array of start, length, period: word numbers from 0, by start and
    period), collapsed (the text without the words that runs repeat, joined by one space).

    Words are the stretches without ASCII white space.  Null, empty and blank texts have no words, no runs and an
    empty collapsed text.  Rows are judged on their own: repeated or null ids are carried along.  No rows give no rows.  Other
    columns are ignored.  Whole texts are read; ``repeats`` must be 4 or more.
    """
    if repeats < 4:
        raise ValueError("the blocks cover runs of at least four periods")
    kind = docs.schema[id_col].dataType.simpleString()

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            split, first, n = [], 0, 0
            for k, text in enumerate(batch["t"]):
                split.append((text or "").encode("utf-8").split())
                n += len(split[-1])
                if n < WORDS_AT_ONCE and k + 1 < len(batch):
                    continue
                numbers: dict[bytes, int] = {}
                ids = np.asarray([numbers.setdefault(w, len(numbers)) for words in split for w in words], np.int64)
                edges = np.concatenate([[0], np.cumsum([len(words) for words in split])])
                runs = find_runs(ids, edges, repeats, shortest)
                yield pd.DataFrame({
                    "id": batch["id"].iloc[first:k + 1], "n_words": np.diff(edges),
                    "runs": [[{"start": s, "length": m, "period": q} for s, m, q in r] for r in runs],
                    "collapsed": [collapse(words, r) for words, r in zip(split, runs)]})
                split, first, n = [], k + 1, 0

    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].cast("string").alias("t"))
    found = rows.mapInPandas(judged, f"id string, n_words long, runs {RUNS}, collapsed string")
    return found.select(F.col("id").cast(kind).alias(id_col), "n_words", "runs", "collapsed")

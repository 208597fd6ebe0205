"""Token counts by finite-state transducers compiled from a byte-level BPE tokenizer file.

Two deterministic transducers annotate their transitions with what they emit:

* ``Splitter`` reads classes of characters and emits where the tokenizer's words start.  It has twelve states, so the
  state map of a chunk of text is a short array; the maps compose through a parallel prefix scan.
* ``Counter`` reads bytes and emits counts of tokens.  Its state is what the byte pairs read so far allow next: the open
  trie nodes of the vocabulary that end here, the merges that may still cross into each, and how many tokens were
  counted since it opened.  The last token of a prefix follows from these alone, so a transition emits the change of the
  prefix's count, which may be negative.  States and transitions are compiled when first met.  Chunks start at words;
  where one word is longer, its chunks' maps are computed for the states that reach them, until every chunk starts as
  the one before it ended.

All chunks of a batch step together through numpy look-ups.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHARS_AT_ONCE = 1 << 20
PART_END = re.compile(r"(?<=[A-Za-z0-9])(?= )")  # a word starts here whatever surrounds it
SPLIT_CHUNK = 128
COUNT_CHUNK = 96
MOST_STATES = 1 << 17  # a larger table is dropped between batches and compiled anew
BREAK = "\ud800"  # before and behind each text; no text holds a surrogate
NEVER = 1 << 30

# symbols of the splitter
TEXT_BREAK, LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE, ENDS, R, V, L, E, UNKNOWN = range(13)
# its states: nothing open, in letters, in numbers, in others; one or more blanks, the last a space or not; a quote
# that starts a word, alone or with a first letter of a contraction
START, LETTERS, NUMBERS, OTHERS, SPACE1, SPACES, BLANK1, BLANKS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(12)
HERE, BEFORE = 1, 2  # a word starts at the symbol just read, at the one before it


def splitter_tables() -> tuple[np.ndarray, np.ndarray]:
    """next[state, symbol] and emitted[state, symbol] of: contractions 's 't 're 've 'm 'll 'd, else letters, numbers or
    others, each with one space in front, else blanks, whose last one is left to what follows."""
    kinds = range(TEXT_BREAK, UNKNOWN)
    letters = {LETTER, ENDS, R, V, L, E}
    opened = {TEXT_BREAK: START, NUMBER: NUMBERS, OTHER: OTHERS, SPACE: SPACE1, BLANK: BLANK1, QUOTE: QUOTED} | dict.fromkeys(letters, LETTERS)
    to, out = np.zeros((12, UNKNOWN), np.uint8), np.zeros((12, UNKNOWN), np.uint8)
    for state in range(12):
        for kind in kinds:
            goes, emits = opened[kind], 0 if kind == TEXT_BREAK else HERE
            if state == LETTERS and kind in letters or state == NUMBERS and kind == NUMBER:
                emits = 0
            elif state == OTHERS and kind in (OTHER, QUOTE):
                goes, emits = OTHERS, 0
            elif state in (SPACE1, SPACES, BLANK1, BLANKS) and kind in (SPACE, BLANK):
                goes, emits = SPACES if kind == SPACE else BLANKS, 0
            elif state in (SPACE1, SPACES) and kind != TEXT_BREAK:
                goes, emits = OTHERS if kind == QUOTE else goes, BEFORE if state == SPACES else 0
            elif state == BLANKS and kind != TEXT_BREAK:
                emits |= BEFORE
            elif state == QUOTED:
                if kind == ENDS:
                    goes, emits = START, 0
                elif kind in (OTHER, QUOTE):
                    goes, emits = OTHERS, 0
                elif kind in (R, V, L):
                    goes, emits = {R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[kind], 0
            elif state in (QUOTED_R, QUOTED_V, QUOTED_L):
                if kind == (L if state == QUOTED_L else E):
                    goes, emits = START, 0
                else:
                    emits = BEFORE if kind in letters else emits | BEFORE
            to[state, kind], out[state, kind] = goes, emits
    return to, out


class Splitter:
    def __init__(self, pre_tokenizer):
        self.pre = pre_tokenizer
        self.to, self.out = splitter_tables()
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.kinds[0xD800] = TEXT_BREAK
        self.learn(np.arange(128))
        for chars, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", ENDS), ("r", R), ("v", V), ("l", L), ("e", E)):
            self.kinds[[ord(c) for c in chars]] = kind

    def learn(self, points: np.ndarray) -> None:
        """Asks the tokenizer's own splitting for the class of code points: a character is of the class of the one
        before it if no word starts between them."""
        chars = [chr(p) for p in points]
        for before, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
            starts = {s for _, (s, _) in self.pre.pre_tokenize_str("".join([before + c + "\n" for c in chars]))}
            same = [3 * k + 1 not in starts for k in range(len(chars))]
            self.kinds[points[same]] = kind
        unknown = points[self.kinds[points] == UNKNOWN]
        self.kinds[unknown] = BLANK

    def starts(self, points: np.ndarray) -> np.ndarray:
        """Whether a word starts at each code point."""
        kinds = self.kinds[points]
        if (kinds == UNKNOWN).any():
            self.learn(np.unique(points[kinds == UNKNOWN]))
            kinds = self.kinds[points]
        n = len(kinds)
        chunks = -(-n // SPLIT_CHUNK)
        steps = np.full(chunks * SPLIT_CHUNK, TEXT_BREAK, np.uint8)
        steps[:n] = kinds
        steps = np.ascontiguousarray(steps.reshape(chunks, SPLIT_CHUNK).T)
        flat, emitted = self.to.ravel(), self.out.ravel()
        maps = np.repeat(np.arange(12, dtype=np.uint8)[:, None], chunks, 1)  # [state before, chunk] -> state behind
        for kind in steps:
            maps = flat.take(maps * np.intp(UNKNOWN) + kind)
        entry = self.entries(maps)
        out = np.empty(steps.shape, np.uint8)
        state = entry.astype(np.intp)
        for k, kind in enumerate(steps):
            at = state * UNKNOWN + kind
            out[k] = emitted.take(at)
            state = flat.take(at).astype(np.intp)
        out = out.T.ravel()[:n]
        found = (out & HERE).astype(bool)
        found[:-1] |= (out[1:] & BEFORE).astype(bool)
        return found

    @staticmethod
    def entries(maps: np.ndarray) -> np.ndarray:
        """The state before each chunk: an inclusive scan of map composition in log2(chunks) rounds."""
        scan, width = maps, 1
        while width < scan.shape[1]:
            scan = np.concatenate([scan[:, :width], np.take_along_axis(scan[:, width:], scan[:, :-width].astype(np.intp), 0)], 1)
            width *= 2
        return np.concatenate([[START], scan[START, :-1]])


class Counter:
    def __init__(self, vocabulary: dict[str, int], merges: list):
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes written as their own character
        spelled = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)).difference(plain)))}
        raw = {t: bytes(spelled[c] for c in t) for t in vocabulary if all(c in spelled for c in t)}
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges]
        self.right_part = [raw[y] for _, y in pairs]
        self.made: dict[bytes, tuple[int, bytes, bytes]] = {}
        self.from_left: dict[bytes, list[int]] = {}
        for rank, (x, y) in enumerate(pairs):
            if raw[x] + raw[y] in self.made:
                raise ValueError(f"two merges make the token {x + y!r}")
            self.made[raw[x] + raw[y]] = (rank, raw[x], raw[y])
            self.from_left.setdefault(raw[x], []).append(rank)
        if any(len(t) == 1 for t in self.made) or len({t for t in raw.values() if len(t) == 1}) < 256:
            raise ValueError("not a byte-level vocabulary")
        self.child: dict[int, int] = {}
        self.ends: list[bytes | None] = [None]
        self.path = [b""]
        for t in raw.values():
            if len(t) == 1 or t in self.made:
                self.insert(t)
        self.inner = {key >> 8 for key in self.child}
        self.sets: list[frozenset[int]] = []
        self.set_ids: dict[frozenset[int], int] = {}
        self.open_after = functools.cache(self.open_after)
        self.left_edge = functools.cache(self.left_edge)
        self.clear()

    def insert(self, token: bytes) -> None:
        node = 0
        for byte in token:
            key = node << 8 | byte
            if key not in self.child:
                self.child[key] = len(self.path)
                self.path.append(self.path[node] + bytes([byte]))
                self.ends.append(None)
            node = self.child[key]
        self.ends[node] = token

    def clear(self) -> None:
        self.narrowed: dict[tuple[int, int], int] = {}
        self.allowed: dict[tuple[int, bytes], bool] = {}
        first = ((0, self.set_id(frozenset()), 0),)
        self.states = {first: 0}
        self.rows = [first]
        self.table = np.full((1 << 10) * 256, -1, np.int32)  # next state << 8 | 128 + emitted count, or not compiled yet

    def set_id(self, merges: frozenset[int]) -> int:
        if merges not in self.set_ids:
            self.set_ids[merges] = len(self.sets)
            self.sets.append(merges)
        return self.set_ids[merges]

    def open_after(self, token: bytes) -> int:
        """The merges that may join an end of ``token`` to what follows: those of each symbol on its right edge that
        come after the symbol is made and before it is merged away."""
        found, gone = [], NEVER
        while True:
            rank = self.made[token][0] if token in self.made else -1
            found += [m for m in self.from_left.get(token, ()) if rank < m < gone]
            if rank < 0:
                return self.set_id(frozenset(found))
            gone, token = rank, self.made[token][2]

    def left_edge(self, token: bytes) -> dict[bytes, int]:
        """The symbols on the token's left edge and the merge that ends each."""
        found, gone = {}, NEVER
        while True:
            found[token] = gone
            if token not in self.made:
                return found
            gone, token, _ = self.made[token]

    def narrow(self, merges: int, node: int) -> int:
        """Those of the merges whose right part agrees with the trie node."""
        if not self.sets[merges]:
            return merges
        if (merges, node) not in self.narrowed:
            path, right = self.path[node], self.right_part
            self.narrowed[merges, node] = self.set_id(frozenset(
                m for m in self.sets[merges] if path.startswith(right[m]) or right[m].startswith(path)))
        return self.narrowed[merges, node]

    def follows(self, merges: int, token: bytes) -> bool:
        """Whether none of the merges happens when ``token`` is the next token."""
        if not self.sets[merges]:
            return True
        if (merges, token) not in self.allowed:
            edge = self.left_edge(token)
            self.allowed[merges, token] = all(edge.get(self.right_part[m], -1) < m for m in self.sets[merges])
        return self.allowed[merges, token]

    def compile(self, key: int) -> None:
        state, byte = key >> 8, key & 255
        opened, change, last = [], 0, b""
        for node, merges, since in self.rows[state]:
            below = self.child.get(node << 8 | byte)
            if below is None:
                continue
            token = self.ends[below]
            if token is not None and not last and self.follows(merges, token):
                change, last = 1 - since, token
            if below in self.inner:
                opened.append((below, self.narrow(merges, below), since))
        row = (*((node, merges, since + change) for node, merges, since in opened), (0, self.open_after(last), 0))
        found = self.states.get(row)
        if found is None:
            found = self.states[row] = len(self.rows)
            self.rows.append(row)
            if found * 256 >= len(self.table):
                self.table = np.concatenate([self.table, np.full(len(self.table), -1, np.int32)])
        self.table[key] = found << 8 | (128 + change)

    def run(self, data: np.ndarray, starts: np.ndarray, at: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State behind and tokens emitted in each chunk data[at:at + size], entered in ``state``; all chunks step together."""
        order = np.argsort(-size, kind="stable")
        at, left = at[order], size[order]
        now, total = state[order].astype(np.int64), np.zeros(len(at), np.int64)
        live = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), side="left")
        for k, n in enumerate(live):
            here = at[:n] + k
            key = np.where(starts[here], 0, now[:n]) << 8 | data[here]
            value = self.table.take(key)
            missing = value < 0
            if missing.any():
                for each in np.unique(key[missing]).tolist():
                    self.compile(each)
                value = self.table.take(key)
            now[:n] = value >> 8
            total[:n] += (value & 255) - 128
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return now[back], total[back]

    def counts(self, data: np.ndarray, starts: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Tokens of each text; ``texts`` holds where each starts in data (empty ones too), ``starts`` where words do."""
        if len(self.rows) > MOST_STATES:
            self.clear()
        n = len(data)
        if n == 0:
            return np.zeros(len(texts), np.int64)
        words = np.flatnonzero(starts)
        grid = np.arange(0, n, COUNT_CHUNK)
        word = words.take(np.searchsorted(words, grid), mode="clip")
        grid = np.where((word >= grid) & (word < grid + COUNT_CHUNK), word, grid)  # at a word if there is one
        at = np.unique(np.concatenate([grid, texts[texts < n]]))
        size = np.diff(at, append=n)
        inside = np.flatnonzero(~starts[at])  # chunks that start within a word
        state, total = self.run(data, starts, at, size, np.zeros(len(at), np.int64))
        entry = np.zeros(len(at), np.int64)
        maps = {}
        while len(inside):
            wrong = inside[entry[inside] != state[inside - 1]]
            if not len(wrong):
                break
            entry[wrong] = state[wrong - 1]
            new = np.asarray([c for c in wrong.tolist() if (c, int(entry[c])) not in maps], np.int64)
            if len(new):
                ends, tokens = self.run(data, starts, at[new], size[new], entry[new])
                maps.update(zip(zip(new.tolist(), entry[new].tolist()), zip(ends.tolist(), tokens.tolist())))
            found = np.asarray([maps[c, int(entry[c])] for c in wrong.tolist()])
            state[wrong], total[wrong] = found[:, 0], found[:, 1]
        sums = np.concatenate([[0], np.cumsum(total)])
        edge = np.append(np.searchsorted(at, texts), len(at))
        return sums[edge[1:]] - sums[edge[:-1]]


class TokenCounter:
    """Counts as the tokenizers library's encode(text, add_special_tokens=False); added tokens found in a text are one each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, added = spec["model"], spec["pre_tokenizer"], spec["added_tokens"]
        if (model["type"] != "BPE" or spec["normalizer"] or not pre or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]
                or model.get("dropout") or model.get("ignore_merges") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix")
                or any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added)):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        self.splitter = Splitter(Tokenizer.from_file(path).pre_tokenizer)
        self.counter = Counter(model["vocab"], model["merges"])
        self.added = re.compile("|".join(re.escape(a["content"]) for a in sorted(added, key=lambda a: -len(a["content"])))) if added else None

    def count(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """UTF-8 bytes and tokens of each text."""
        parts, sizes, owner, extra = [], [], [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            cut = self.added.split(text) if self.added else [text]
            extra[k] = len(cut) - 1
            parts += cut
            owner += [k] * len(cut)
        joined = "".join(parts)
        raw = joined.encode("utf-8")
        marked = BREAK.join(["", *parts, ""])
        points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4")
        found = self.splitter.starts(points)[points != 0xD800]
        lengths = np.asarray([len(p) for p in parts], np.int64)
        first = np.cumsum(lengths) - lengths
        if len(raw) == len(joined):
            starts, at = found, first
        else:
            points = points[points != 0xD800]
            width = np.add((points > 0x7F).view(np.uint8) + (points > 0x7FF) + (points > 0xFFFF), 1, dtype=np.uint8)
            offset = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
            starts = np.zeros(len(raw), bool)
            starts[offset[:-1][found]] = True
            at = offset[first]
        tokens = np.zeros(len(texts), np.int64)
        np.add.at(tokens, owner, self.counter.counts(np.frombuffer(raw, np.uint8), starts, at))
        sizes = [len(t.encode("utf-8")) for t in texts]
        return sizes, (tokens + extra).tolist()


@functools.cache
def token_counter(path: str) -> TokenCounter:
    """One compiled table a worker process, for all its tasks."""
    return TokenCounter(path)


def cut_long(text: str) -> Iterator[str]:
    """A long text cut where words start, about every million characters."""
    at = 0
    while len(text) - at > CHARS_AT_ONCE and (found := PART_END.search(text, at + CHARS_AT_ONCE)):
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: <id_col>, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as an empty one: 0 bytes, 0 tokens.  Ids are carried along, null or repeated; rows are never
    joined.  No rows give no rows.  Other columns are ignored.  Whole texts are read, about a million characters at a
    time; only a run without a blank behind a letter or digit is longer.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = token_counter(tokenizer_path)
        for batch in batches:
            sums, waiting, owners, chars = np.zeros((2, len(batch)), np.int64), [], [], 0

            def flush():
                np.add.at(sums, (slice(None), owners), np.asarray(counter.count(waiting)))
                waiting.clear(), owners.clear()

            for k, text in enumerate(batch["t"]):
                for part in cut_long(text or ""):
                    waiting.append(part)
                    owners.append(k)
                    chars += len(part)
                    if chars >= CHARS_AT_ONCE:
                        flush()
                        chars = 0
            if waiting:
                flush()
            yield pd.DataFrame({"id": batch["id"], "n_bytes": sums[0], "n_tokens": sums[1]})

    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].cast("string").alias("t"))
    found = rows.mapInPandas(counted, "id string, n_bytes long, n_tokens long")
    return found.select(F.col("id").cast(kind).alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

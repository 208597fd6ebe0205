"""SimHash near-dedup through a Gray-order hierarchical index.

Two fingerprints that differ in at most d bits agree on at least four of d + 4 bit blocks.  The top level of
the index therefore has a node for each choice of four blocks (a mask) and each masked bit pattern; a
fingerprint goes to the node of every mask, and Spark deals nodes out over tasks.  Under a node the codes
stand in Gray order and are factored into nodes of neighbours: a node holds the bits all its codes share,
less those that the node above holds.  A search goes down from the top, adds up the differences on the
shared bits and leaves a node with all its codes once the sum exceeds d.

A node of the top level fixes 42 of 64 bits (d = 2), so it holds at most 2^22 distinct codes.  It yields one
edge from each linked code to the smallest code that it is linked with, not its pairs.  Components of
the edges are found with alternating large and small stars.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.common import checkpointed, shuffle_partitions, written

BITS = 64
HASHES_AT_ONCE = 1 << 16
SHARED_BLOCKS = 4
FANOUT = 8
PAIRS_AT_ONCE = 1 << 20


# ---- fingerprints ---------------------------------------------------------------------------------------

def simhash(text: str | None, words: int = 3) -> int:
    """The fingerprint of a whole text: bit b is set if it is set in over half the XXH64 (seed 42) of its
    shingles of ``words`` words, repeats included; 0 without words."""
    import xxhash

    found = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII white-space bytes
    n = max(1, len(found) - words + 1) if found else 0
    hashed = partial(xxhash.xxh64_intdigest, seed=42)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        part = found[at:min(at + HASHES_AT_ONCE, n) + words - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(words)))) if len(part) >= words else [b" ".join(part)]
        h = np.fromiter(map(hashed, shingles), np.dtype("<u8"))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > n))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, ranked: bool = False) -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed 64-bit integer.  Null and empty texts: 0.  With ``ranked`` also
    rank, the text's hash."""
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.fromiter((simhash(t, words) for t in batch["t"]), np.uint64, len(batch))
            yield pd.DataFrame({"id": batch["id"], "fp": fps.view(np.int64)} | ({"rank": batch["rank"]} if ranked else {}))

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("t"))
    rows = rows.withColumn("rank", F.xxhash64("t")) if ranked else rows
    kind = rows.schema["id"].dataType.simpleString()
    return rows.withColumn("id", F.col("id").cast("string")).mapInPandas(made, "id string, fp long" + ", rank long" * ranked).select(
        F.col("id").cast(kind).alias("id"), "fp", *(["rank"] if ranked else []))


# ---- index ----------------------------------------------------------------------------------------------

def masks(distance: int) -> list[int]:
    blocks = distance + SHARED_BLOCKS
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(block, SHARED_BLOCKS)]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order: bit b is the parity of the code's bits from b up."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def levels(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """From the top down: each level's nodes as (mask of the bits that all codes below share and no node
    above holds, their pattern).  The last level is the codes.  Node i's children are i * FANOUT and on."""
    low, high = [codes], [codes]  # AND and OR of the codes below
    while len(low[-1]) > FANOUT:
        starts = np.arange(0, len(low[-1]), FANOUT)
        low.append(np.bitwise_and.reduceat(low[-1], starts))
        high.append(np.bitwise_or.reduceat(high[-1], starts))
    out, above = [], np.zeros(len(low[-1]), np.uint64)
    for a, b in zip(low[::-1], high[::-1]):
        shared = ~(a ^ b)
        out.append((shared & ~(np.repeat(above, FANOUT)[: len(a)] if out else above), a))
        above = shared
    return out


def linked(codes: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i > j, of Gray-ordered distinct ``codes`` at most ``distance`` bits apart, in parts."""
    tree = levels(codes)
    step = max(1, PAIRS_AT_ONCE // max(len(tree[0][0]), len(codes)))
    for at in range(0, len(codes), step):
        query = np.arange(at, min(at + step, len(codes)))
        top = np.arange(len(tree[0][0]))
        q, node = np.repeat(query, len(top)), np.tile(top, len(query))
        total = np.zeros(len(q), np.uint8)
        for depth, (mask, pattern) in enumerate(tree):
            if depth:  # the children of what is left
                q, total = np.repeat(q, FANOUT), np.repeat(total, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                there = node < len(mask)
                q, node, total = q[there], node[there], total[there]
            total = total + np.bitwise_count((codes[q] ^ pattern[node]) & mask[node])
            near = total <= distance
            q, node, total = q[near], node[near], total[near]
        before = node < q
        yield q[before], node[before]


def smallest_linked(codes: np.ndarray, distance: int) -> np.ndarray:
    """For each of the distinct Gray-ordered codes the first index that it is connected with."""
    label = np.arange(len(codes))
    for i, j in linked(codes, distance):
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := label[label], label):
                label = up
    return label


def edges(fps: DataFrame, distance: int) -> DataFrame:
    """(a, b), a > b, over distinct fingerprints ``fp``: links whose components are those of all links."""
    known = [np.uint64(m) for m in masks(distance)]
    nodes = fps.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("m"), F.col("fp").bitwiseAND(F.lit(int(m.view(np.int64)))).alias("p"), F.col("fp").alias("fp"),
                 ) for k, m in enumerate(known)])).alias("x")).select("x.*")

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def grouped(rows: pd.DataFrame) -> pd.DataFrame:
            """Rows of whole top-level nodes, which stand together."""
            m, p, fp = rows["m"].to_numpy(), rows["p"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
            first = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (p[1:] != p[:-1])])
            last = np.r_[first[1:], len(m)]
            a, b = [], []
            for s, e in zip(first[last - first > 1], last[last - first > 1]):
                codes = fp[s:e]
                codes = codes[np.argsort(gray_rank(codes))]
                label = smallest_linked(codes, distance)
                moved = np.flatnonzero(label != np.arange(len(codes)))
                a.append(codes[moved])
                b.append(codes[label[moved]])
            none = np.zeros(0, np.uint64)
            return pd.DataFrame({"a": np.concatenate([none, *a]).view(np.int64), "b": np.concatenate([none, *b]).view(np.int64)})

        held: list[pd.DataFrame] = []  # the last node's rows, until the next node begins
        for batch in batches:
            if not len(batch):
                continue
            m, p = batch["m"].to_numpy(), batch["p"].to_numpy()
            new = np.flatnonzero((m != m[-1]) | (p != p[-1]))
            cut = new[-1] + 1 if len(new) else 0
            if held and (cut or (held[-1]["m"].iat[-1], held[-1]["p"].iat[-1]) != (m[0], p[0])):
                yield grouped(pd.concat([*held, batch.iloc[:cut]]))
                held = []
            elif cut:
                yield grouped(batch.iloc[:cut])
            held.append(batch.iloc[cut:])
        if held:
            yield grouped(pd.concat(held))

    n = shuffle_partitions(fps.sparkSession)
    found = nodes.repartition(n, "m", "p").sortWithinPartitions("m", "p").mapInPandas(searched, "a long, b long")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node that it is connected with.
    Alternates large and small stars; each round is checkpointed to the shared folder."""
    def pairs(*of: tuple[str, str]):
        return F.explode(F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in of])).alias("e")

    star = checkpointed(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(rounds):
        both = star.select(pairs(("a", "b"), ("b", "a"))).select("e.*")
        least = both.groupBy(F.col("u").alias("w")).agg(F.min(F.least("u", "v")).alias("m"))
        large = (both.join(least, F.col("u") == F.col("w")).filter("v > u and v <> m")
                 .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy(F.col("a").alias("w")).agg(F.min("b").alias("m"))
        small = (large.join(least, F.col("a") == F.col("w")).select(pairs(("b", "m"), ("a", "m")))
                 .filter("e.u <> e.v").select(F.col("e.u").alias("a"), F.col("e.v").alias("b")).distinct())
        star = checkpointed(small)
        now = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    return star.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _rooted(nodes: DataFrame, distance: int) -> DataFrame:
    """``nodes`` (fp, least), distinct fingerprints, with the root of their component."""
    roots = components(edges(nodes.select("fp"), distance))
    return nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
               distance: int = 2) -> DataFrame:
    """(<id_col>, fingerprint, component_id), one row per row of ``docs``: the SimHash as 16 hex digits and the
    smallest id among rows that links of at most ``distance`` bits reach.

    Null and empty texts have the fingerprint zero and are linked like any other.  Null ids never name a
    component unless it has no other (then component_id is null).  Rows that share an id keep a row each.
    No rows give no rows.  Other columns are ignored.
    """
    prints = written(fingerprints(docs, id_col, text_col, words), "simhash")
    rooted = _rooted(prints.groupBy("fp").agg(F.min("id").alias("least")), distance)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select(F.col("fp").alias("node_fp"), "component_id")
    return prints.join(named, F.col("fp") == F.col("node_fp")).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """The rows of ``docs`` without their near copies: of each component the first row by id (null last), text hash and
    the hash of the whole row (but for columns of maps).

    Null and empty texts have no words; their rows are copies of each other, so one of them stays.  Rows that share an id, or have none,
    are documents of their own; of equal rows one stays.  No rows give no rows.  A row travels as one struct, so its columns
    may have any names."""
    prints = written(fingerprints(docs, id_col, text_col, words, ranked=True), "simhash")
    name = F.struct(F.col("id").isNull().alias("first_none"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("first_id"), F.col("rank").alias("first_rank"))
    nodes = prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rank", name.alias("name"))).alias("least"))
    first = _rooted(nodes, distance).groupBy("root").agg(F.min("least").alias("least")).select("least.name.*")
    whole = [docs[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].isNull().alias("none"),
                       F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"),
                       F.xxhash64(docs[text_col].cast("string")).alias("rank"), F.xxhash64(*whole).alias("whole"))
    equal = Window.partitionBy("none", "id", "rank").orderBy("whole")  # rows of one id and text
    same = (F.col("none") == F.col("first_none")) & (F.col("id") == F.col("first_id")) & (F.col("rank") == F.col("first_rank"))
    kept = rows.join(first, same, "left_semi").withColumn("place", F.row_number().over(equal)).filter("place = 1")
    return kept.select("row.*")

"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A paragraph's 64-bit digest is added to one cell of each of three subtables; a cell holds a count and the XOR
of its digests and of their check hashes.  Sketches of two versions subtract cell by cell, which leaves the
digests that only one of them has, and peeling recovers these from cells that hold a single digest.  Where
that fails, larger sketches of both are made, up to sizes far beyond any text; what even the largest can't
peel is compared digest by digest.

All of it runs in the JVM.  Cells and peeling steps are rows grouped by (block, row, ...), and blocks are what the
rows are partitioned by, so a document's cells never leave its task.  Only non-empty cells are rows: a larger
sketch costs no more rows than the digests need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.common import array_literal, evenly, lower_bound, shuffle_partitions

LONGEST_PARAGRAPH = 200  # characters; a longer line is cut at the ends of its sentences
SIZES = (8, 128, 4096, 1 << 17)  # cells of a subtable: the first is the fingerprint, the others are for retries
ROUNDS = (6, 9, 9, 12)
BLOCKS_PER_PARTITION = 4
SAMPLED_PER_BLOCK = 24


# ---- digests and cells ----------------------------------------------------------------------------------

def digests(text: Column, longest: int = LONGEST_PARAGRAPH) -> Column:
    """The distinct digests of a text's paragraphs: its lines, long ones cut at sentence ends; blank ones don't
    count."""
    lines = F.split(text, "\n+")
    parts = F.flatten(F.transform(lines, lambda x: F.when(F.length(x) > longest, F.split(x, r"(?<=[.!?])\s+")).otherwise(F.array(x))))
    kept = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.transform(kept, lambda x: F.xxhash64(x)))


def cell(key: Column, subtable: int, size: int) -> Column:
    mixed = F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 20 * subtable)
    return (mixed.bitwiseAND(F.lit(size - 1)) + subtable * size).cast("int")


def check(key: Column) -> Column:
    return F.hash(key)


def pack_cells(cells: Column, count: str, key: str, chk: str) -> Column:
    """Base64 of the sorted cells, 14 bytes each: count, digests, checks."""
    low = F.lit(0xFFFFFFFF)
    one = lambda c: F.concat(F.lpad(F.hex(c[count].cast("long").bitwiseAND(low)), 8, "0"), F.lpad(F.hex(c[key]), 16, "0"),
                             F.lpad(F.hex(c[chk].cast("long").bitwiseAND(low)), 8, "0"))
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(cells, one), ""))), "\r\n", "")


# ---- subtracting and peeling ----------------------------------------------------------------------------

def sketched(rows: DataFrame, others: int, size: int, pending: list[Column]) -> DataFrame:
    """(b, k, payload, cell, n0, x0, c0, n1, x1, c1, ...): the non-empty cells of the sketches of ``payload.own``
    (0) and of ``payload.others[i - 1]`` (i) where comparison i is pending, and a row with cell -1 that carries
    the payload."""
    one = lambda side: lambda x: F.struct(F.lit(side).alias("side"), x.alias("key"))
    empty = F.array().cast("array<struct<side:int,key:bigint>>")
    any_pending = pending[0]
    for p in pending[1:]:
        any_pending = any_pending | p
    items = [F.when(any_pending, F.transform("payload.own", one(0))).otherwise(empty)]
    items += [F.when(p, F.transform(F.col("payload.others")[i], one(i + 1))).otherwise(empty) for i, p in enumerate(pending)]
    carrier = F.array(F.struct(F.lit(-1).alias("side"), F.lit(0).cast("long").alias("key")))
    rows = rows.select("b", "k", "payload", F.explode(F.concat(carrier, *items)).alias("i")).select(
        "b", "k", F.when(F.col("i.side") < 0, F.col("payload")).alias("payload"), "i.side", "i.key")
    places = F.array(*[cell(F.col("key"), j, size) for j in range(3)])
    rows = rows.select("b", "k", "payload", "side", "key", F.explode(F.when(F.col("side") < 0, F.array(F.lit(-1))).otherwise(places)).alias("cell"))
    sums = []
    for i in range(others + 1):
        here = F.col("side") == i
        sums += [F.sum(F.when(here, 1).otherwise(0)).alias(f"n{i}"), F.bit_xor(F.when(here, F.col("key")).otherwise(F.lit(0).cast("long"))).alias(f"x{i}"),
                 F.bit_xor(F.when(here, check(F.col("key"))).otherwise(0)).alias(f"c{i}")]
    return rows.groupBy("b", "k", "payload", "cell").agg(*sums)


def differences(others: int) -> Column:
    """Of a row of sketched(): the cells of own minus each other sketch, as structs (pair, cell, n, x, c)."""
    return F.array(*[F.struct(
        F.lit(i).alias("pair"), F.col("cell").alias("cell"), (F.col("n0") - F.col(f"n{i}")).cast("long").alias("n"),
        F.col("x0").bitwiseXOR(F.col(f"x{i}")).alias("x"), F.col("c0").bitwiseXOR(F.col(f"c{i}")).alias("c")) for i in range(1, others + 1)])


EMPTY = "n = 0 and x = 0 and c = 0"


def peeled(rows: DataFrame, size: int, rounds: int, keep_digests: bool) -> DataFrame:
    """Rows (b, k, payload, pair, cell, n, x, c, got) after ``rounds`` rounds.  Round r takes the cells of subtable
    r mod 3 that hold one digest, takes it out of its two other cells, and leaves a row with cell -1, n = 1,
    and with ``keep_digests`` the digest in ``got`` and its sign in ``c``."""
    group = ["b", "k", "payload", "pair", "cell", "got"]
    for r in range(rounds):
        sub = r % 3
        x = F.col("x")
        pure = ((F.col("cell") >= sub * size) & (F.col("cell") < (sub + 1) * size) & (F.abs("n") == 1)
                & (F.col("c") == check(x)) & (F.col("cell") == cell(x, sub, size)))
        row = lambda at, n, x, c, got: F.struct(at.alias("cell"), n.cast("long").alias("n"), x.cast("long").alias("x"),
                                                c.cast("int").alias("c"), got.cast("long").alias("got"))
        off = [row(cell(x, j, size), -F.col("n"), x, F.col("c"), F.lit(None)) for j in range(3) if j != sub]
        found = row(F.lit(-1), F.lit(1), F.lit(0), F.col("n") if keep_digests else F.lit(0), x if keep_digests else F.lit(None))
        same = row(F.col("cell"), F.col("n"), x, F.col("c"), F.col("got"))
        rows = rows.select("b", "k", "payload", "pair", F.explode(F.when(pure, F.array(*off, found)).otherwise(F.array(same))).alias("y"))
        rows = (rows.select("b", "k", "payload", "pair", "y.*").groupBy(*group)
                .agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("c").alias("c"))
                .filter(F.col("payload").isNotNull() | ~F.expr(EMPTY)))
    return rows


def compared(rows: DataFrame, others: int, sizes: tuple[int, ...] = SIZES, rounds: tuple[int, ...] = ROUNDS,
             keep_digests: bool = False) -> DataFrame:
    """``rows`` (b, k, payload), hash-partitioned by b and (b, k) unique, with payload.own: array<bigint> and
    payload.others: array<array<bigint>>.  Adds prints: the fingerprints of own and the others, differ: how many
    digests each pair differs in, at: the subtable size that peeled it (0: compared directly), and with
    ``keep_digests`` found: the digests with their sign (1: only own has it), null if compared directly."""
    pairs = range(1, others + 1)
    got = "array<struct<pair:int,sign:int,digest:bigint>>"
    rows = rows.select("b", "k", F.struct(
        "payload.*", F.lit(None).cast("array<string>").alias("prints"),
        F.array(*[F.lit(None).cast("long") for _ in pairs]).alias("differ"), F.array(*[F.lit(None).cast("int") for _ in pairs]).alias("at"),
        F.array().cast(got).alias("found")).alias("payload"))
    for step, (size, count) in enumerate(zip(sizes, rounds)):
        pending = [F.col("payload.differ")[i - 1].isNull() for i in pairs]
        cells = sketched(rows, others, size, pending)
        none = F.struct(F.lit(0).alias("pair"), F.lit(-1).alias("cell"), *[F.lit(0).cast(t).alias(n) for n, t in (("n", "long"), ("x", "long"), ("c", "int"))])
        if not step:  # the fingerprints are cells of the smallest sketch, all 3 * size of them
            values = [c for c in cells.columns if c[1:].isdigit()]
            docs = cells.groupBy("b", "k").agg(F.collect_list("payload")[0].alias("payload"), F.sort_array(F.collect_list(
                F.when(F.col("cell") >= 0, F.struct("cell", *values)))).alias("cells"))
            by_cell = F.map_from_arrays(F.transform("cells", lambda c: c["cell"]), F.col("cells"))
            docs = docs.withColumn("by_cell", by_cell)
            blank = F.struct(F.lit(0).alias("cell"), *[F.lit(0).cast(dict(cells.dtypes)[v]).alias(v) for v in values])
            full = F.transform(F.sequence(F.lit(0), F.lit(3 * size - 1)), lambda i: F.coalesce(F.col("by_cell")[i], blank))
            docs = docs.withColumn("full", full).withColumn("prints", F.array(*[pack_cells(F.col("full"), f"n{i}", f"x{i}", f"c{i}") for i in range(others + 1)]))
            payload = F.col("payload").withField("prints", F.col("prints"))
            diff = lambda i: lambda c: F.struct(F.lit(i).alias("pair"), c["cell"].alias("cell"), (c["n0"] - c[f"n{i}"]).cast("long").alias("n"),
                                                c["x0"].bitwiseXOR(c[f"x{i}"]).alias("x"), c["c0"].bitwiseXOR(c[f"c{i}"]).alias("c"))
            cells = docs.select("b", "k", payload.alias("payload"), F.explode(F.concat(F.array(none), *[F.transform("cells", diff(i)) for i in pairs])).alias("y"))
            cells = cells.select("b", "k", F.when(F.col("y.pair") == 0, F.col("payload")).alias("payload"), "y.*")
        else:
            cells = cells.select("b", "k", "payload", F.explode(F.when(F.col("cell") < 0, F.array(none)).otherwise(differences(others))).alias("y"))
            cells = cells.select("b", "k", "payload", "y.*")
        cells = cells.filter(F.col("payload").isNotNull() | ~F.expr(EMPTY)).withColumn("got", F.lit(None).cast("long"))
        left = peeled(cells, size, count, keep_digests)
        sums = []
        for i in pairs:
            mine = F.col("pair") == i
            sums += [F.sum(F.when(mine & (F.col("cell") >= 0), 1).otherwise(0)).alias(f"left{i}"),
                     F.sum(F.when(mine & (F.col("cell") < 0), F.col("n")).otherwise(0)).alias(f"found{i}")]
        listed = F.collect_list(F.when(F.col("got").isNotNull(), F.struct(F.col("pair").cast("int").alias("pair"), F.col("c").alias("sign"), F.col("got").alias("digest"))))
        docs = left.groupBy("b", "k").agg(F.collect_list("payload")[0].alias("payload"), *sums, *([listed.alias("listed")] if keep_digests else []))
        done = [F.col("payload.differ")[i - 1].isNull() & (F.col(f"left{i}") == 0) for i in pairs]
        payload = F.col("payload")
        if keep_digests:
            ok = F.array(*done)
            payload = payload.withField("found", F.concat("payload.found", F.filter("listed", lambda x: ok[x["pair"] - 1])))
        payload = payload.withField("differ", F.array(*[F.when(done[i - 1], F.col(f"found{i}")).otherwise(F.col("payload.differ")[i - 1]) for i in pairs]))
        payload = payload.withField("at", F.array(*[F.when(done[i - 1], F.lit(size)).otherwise(F.col("payload.at")[i - 1]) for i in pairs]))
        rows = docs.select("b", "k", payload.alias("payload"))
    own = F.col("payload.own")
    direct = [F.size(own) + F.size(F.col("payload.others")[i - 1]) - 2 * F.size(F.array_intersect(own, F.col("payload.others")[i - 1])) for i in pairs]
    rows = rows.select("b", "k", F.col("payload")
                       .withField("differ", F.array(*[F.coalesce(F.col("payload.differ")[i - 1], direct[i - 1].cast("long")) for i in pairs]))
                       .withField("at", F.array(*[F.coalesce(F.col("payload.at")[i - 1], F.lit(0)) for i in pairs])).alias("payload"))
    return rows


def likeness(a: Column, b: Column, differ: Column) -> Column:
    """Shared over all distinct digests; 1 for two texts without any."""
    every = a + b + differ
    return F.when(every == 0, 1.0).otherwise((a + b - differ) / every)


# ---- documents ------------------------------------------------------------------------------------------

def with_next(docs: DataFrame, id_col: str, text_col: str, seed: int = 1) -> DataFrame:
    """(b, k, id, text, keys, next_text, next_keys): every row with the text of the row with the next larger id (after
    the last: the first); rows of one id follow each other by their text's hash.  Sampled splitters cut the ids into blocks; the first
    row of a block is also sent to the block before it.  Null ids have no next."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    blocks = n * BLOCKS_PER_PARTITION
    ids = rows.select("id").filter("id is not null")
    total = ids.count()
    share = min(1.0, 1.2 * blocks * SAMPLED_PER_BLOCK / max(1, total))
    cuts = evenly(sorted(r[0] for r in (ids.sample(False, share, seed) if share < 1 else ids).collect()), blocks)
    block = lower_bound(F.from_json(F.lit(str(cuts)), "array<bigint>"), len(cuts), F.col("id"))
    firsts = {r["b"]: r["id"] for r in ids.withColumn("b", block).groupBy("b").agg(F.min("id").alias("id")).collect()}
    there = sorted(firsts)
    before = {b: there[k - 1] for k, b in enumerate(there)}  # of the first: the last
    place = array_literal([{"first": firsts.get(b), "before": before.get(b, b), "wraps": bool(there) and b == there[0]}
                           for b in range(len(cuts) + 1)], "struct<first:bigint,before:int,wraps:boolean>")
    here = F.get(place, block)
    one = lambda b, ghost, wraps: F.struct(b.cast("int").alias("b"), ghost.alias("ghost"), wraps.alias("wraps"))
    no = F.lit(False)
    spread = one(-1 - F.pmod(F.xxhash64("text"), F.lit(blocks)), no, no)
    goes = (F.when(F.col("id").isNull(), F.array(spread))
            .when(F.col("id") == here["first"], F.array(one(block, no, no), one(here["before"], F.lit(True), here["wraps"])))
            .otherwise(F.array(one(block, no, no))))
    dealt = rows.select("id", "text", F.explode(goes).alias("g")).select("id", "text", "g.*").repartition(n, "b")
    dealt = dealt.withColumn("keys", digests(F.col("text"))).withColumn("h", F.xxhash64("text"))
    order = Window.partitionBy("b").orderBy("wraps", "id", "h", "ghost")
    after = dealt.select("b", F.row_number().over(order).alias("k"), "id", "text", "keys", "ghost",
                         F.lead("text").over(order).alias("next_text"), F.lead("keys").over(order).alias("next_keys")).filter("not ghost")
    known = F.col("id").isNotNull()
    return after.select("b", "k", "id", "text", "keys", F.when(known, F.col("next_text")).alias("next_text"), F.when(known, F.col("next_keys")).alias("next_keys"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(<id_col>, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_differ,
    next_differ), one row per row of ``docs``.  The edited text has its last floor(n_chars / 2) characters replaced by the first as many
    of the next document.  near: shared over all distinct paragraph digests, from the peeled difference.

    Null texts count as empty; two texts without paragraphs are alike (1).  A null id has no place in the order:
    its edited text is cut only and near_next is null.  Rows of one id are ordered by their text.  A single row
    is its own next.  No rows give no rows.  Other columns are ignored."""
    rows = with_next(docs, id_col, text_col)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))"),
                      F.when(F.col("next_text").isNull(), "").otherwise(F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.withColumn("edited", edited)
    rows = rows.select("b", "k", F.struct(
        "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("next_text").isNotNull().alias("has_next"), F.col("keys").alias("own"),
        F.array(digests(F.col("edited")), F.coalesce("next_keys", F.array().cast("array<bigint>"))).alias("others")).alias("payload"))
    p = compared(rows, 2).select("payload.*")
    a, b, c = F.size("own"), F.size(F.col("others")[0]), F.size(F.col("others")[1])
    return p.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", F.col("prints")[0].alias("fingerprint"), F.col("prints")[1].alias("edited_fingerprint"),
        likeness(a, b, F.col("differ")[0]).alias("near_edited"), F.when(F.col("has_next"), likeness(a, c, F.col("differ")[1])).alias("near_next"),
        F.col("differ")[0].alias("edited_differ"), F.when(F.col("has_next"), F.col("differ")[1]).alias("next_differ"))


def differing_digests(versions: DataFrame, id_col: str, old_col: str, new_col: str) -> DataFrame:
    """(<id_col>, digest, sign): the paragraph digests that only the old (1) or only the new text (-1) of a row has, recovered from
    the difference of their sketches.  Null texts count as empty."""
    n = shuffle_partitions(versions.sparkSession)
    text = lambda c: F.coalesce(versions[c].cast("string"), F.lit(""))
    rows = versions.select(versions[id_col].alias("id"), text(old_col).alias("old"), text(new_col).alias("new"))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("id", "old", "new"), F.lit(n * BLOCKS_PER_PARTITION)).cast("int")).repartition(n, "b")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy("id")))
    rows = rows.select("b", "k", F.struct("id", digests(F.col("old")).alias("own"), F.array(digests(F.col("new"))).alias("others")).alias("payload"))
    p = compared(rows, 1, keep_digests=True).select("payload.*")
    mine = F.transform(F.array_except("own", F.col("others")[0]), lambda x: F.struct(F.lit(1).alias("sign"), x.alias("digest")))
    its = F.transform(F.array_except(F.col("others")[0], F.col("own")), lambda x: F.struct(F.lit(-1).alias("sign"), x.alias("digest")))
    listed = F.transform("found", lambda x: F.struct(x["sign"].alias("sign"), x["digest"].alias("digest")))
    every = F.when(F.col("at")[0] > 0, listed).otherwise(F.concat(mine, its))
    return p.select(F.col("id").alias(id_col), F.explode(every).alias("y")).select(id_col, "y.digest", "y.sign")

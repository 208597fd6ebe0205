"""E8 against a dimension table of any size: exact, containing and word-sharing names, by equi-joins alone.

Containment: a name can only hold another if it holds the other's rarest gram, so each contained side is joined by that
one gram and the pair verified.  Grams are 1, 2, 4 or 8 characters long, so their number is linear in a name's length.

Shared words: words of at most ``common`` candidates are joined as they are.  Candidates that share nothing but common
words with a name are told apart only by which common words they hold, so of each such set the first candidate stands for
all, and distinct sets of names meet distinct sets of candidates.  The best row is the same as over all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.text import nz
from gazette.sources.dims import unique_dim

GRAMS = (1, 2, 4, 8)
COMMON = 256


def _words(c: Column) -> Column:
    return F.split(c, r"\s+")


def _grams(c: Column, size: int) -> Column:
    """The distinct substrings of ``size`` characters, in one scan; none where the text is shorter."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def containing(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """(t, p) for each distinct ``t`` of ``texts`` and non-empty ``p`` of ``parts`` that it holds.

    Both sides hold distinct strings.  A part is joined by the gram that the fewest texts hold; gram rows carry a key and
    a length, and the strings come back for the check.  Gram tables are large on either side: they are merged, not broadcast."""
    texts = texts.select("t", F.xxhash64("t").alias("tk"), F.length("t").alias("tl"))
    parts = parts.filter("p <> ''").select("p", F.xxhash64("p").alias("pk"), F.length("p").alias("pl"))
    held = texts.select("tk", "tl", F.explode(F.flatten(F.array(*[_grams(F.col("t"), n) for n in GRAMS]))).alias("gram"))
    own = F.coalesce(*[F.when(F.col("pl") >= n, _grams(F.col("p"), n)) for n in reversed(GRAMS)])
    wanted = parts.select("pk", "pl", F.explode(own).alias("gram"))
    spread = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    anchors = (wanted.join(spread.hint("merge"), "gram", "left").groupBy("pk", "pl")
               .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("a")).filter("a.n > 0")
               .select("pk", "pl", F.col("a.gram").alias("gram")))
    near = held.join(anchors.hint("merge"), "gram").filter("pl <= tl").select("tk", "pk").distinct()
    both = near.join(texts.select("t", "tk"), "tk").join(parts.select("p", "pk"), "pk")
    return both.filter(F.instr(F.col("t"), F.col("p")) > 0).select("t", "p")


def word_pairs(names: DataFrame, cands: DataFrame, common: int = COMMON) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What shared words are scored on, all by counting joined words:

    - rare (q, lname, ordinal, id, n): names and candidates with n words in common that at most ``common`` candidates
      hold; a word that the name repeats counts as often.
    - met (nset, cset, first, n): sets of commoner words that share n; ``first`` is the first candidate of the set (neg, id).
    - (q, nset) and (lname, cset): the commoner words of each name, with how often it has them, and of each candidate.
    """
    held = cands.select("ordinal", "id", "lname", F.explode(F.array_distinct(_words(F.col("lname")))).alias("w"))
    hot = held.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > common).select("w", F.lit(True).alias("hot"))
    held = held.join(hot, "w", "left")
    asked = names.select("q", F.explode(_words(F.col("q"))).alias("w")).groupBy("q", "w").agg(F.count(F.lit(1)).alias("m")).join(hot, "w", "left")
    rare = (asked.filter("hot is null").drop("hot").join(held.filter("hot is null").drop("hot"), "w")
            .groupBy("q", "lname", "ordinal", "id").agg(F.sum("m").alias("n")))
    of_name = asked.filter("hot").groupBy("q").agg(F.sort_array(F.collect_list(F.struct("w", "m"))).alias("nset"))
    of_cand = held.filter("hot").groupBy("lname", "ordinal", "id").agg(F.sort_array(F.collect_set("w")).alias("cset"))
    csets = of_cand.groupBy("cset").agg(F.max(F.struct((-F.col("ordinal")).alias("neg"), "id")).alias("first"))
    met = (of_name.select("nset").distinct().select("nset", F.explode("nset").alias("x")).select("nset", "x.w", "x.m")
           .join(csets.select("cset", "first", F.explode("cset").alias("w")), "w").groupBy("nset", "cset", "first").agg(F.sum("m").alias("n")))
    return rare, met, of_name, of_cand.select("lname", "cset")


def best_matches(names: DataFrame, cands: DataFrame, common: int = COMMON) -> DataFrame:
    """(q, best struct<score, neg, id>) of the names that any candidate fits."""
    inside = (containing(names.select(F.col("q").alias("t")), cands.select(F.col("lname").alias("p"))).withColumnsRenamed({"t": "q", "p": "lname"})
              .join(cands, "lname").select("q", F.length("lname").alias("score"), "ordinal", "id"))
    around = (containing(cands.select(F.col("lname").alias("t")), names.select(F.col("q").alias("p"))).withColumnsRenamed({"t": "lname", "p": "q"})
              .join(cands, "lname").select("q", F.length("q").alias("score"), "ordinal", "id"))
    rare, met, of_name, of_cand = word_pairs(names, cands, common)
    more = met.select("nset", "cset", F.col("n").alias("more"))
    shared = (rare.join(of_name, "q", "left").join(of_cand, "lname", "left").join(more, ["nset", "cset"], "left")
              .select("q", ((F.col("n") + F.coalesce("more", F.lit(0))) * 5).cast("int").alias("score"), "ordinal", "id"))
    by_set = met.groupBy("nset").agg(F.max(F.struct("n", "first")).alias("s"))
    common_only = of_name.join(by_set, "nset").select("q", (F.col("s.n") * 5).cast("int").alias("score"),
                                                      (-F.col("s.first.neg")).alias("ordinal"), F.col("s.first.id").alias("id"))
    every = inside.unionByName(around).unionByName(shared).unionByName(common_only)
    return every.groupBy("q").agg(F.max(F.struct("score", (-F.col("ordinal")).alias("neg"), "id")).alias("best"))


def match_dim_table(df: DataFrame, name: str, dim: DataFrame, prefix: str, common: int = COMMON) -> DataFrame:
    """E8 against a dimension table (ordinal, id, name) of any size, with the results of ``enrich.match_dim_by_name``.
    Distinct names are matched once and joined back.  Of equal candidate names the first counts; a null or blank name
    matches nothing.  ``common`` only moves work between the two ways that words are compared."""
    q = F.lower(F.trim(nz(name)))
    names = df.select(q.alias("q")).filter(F.col("q") != "").distinct()
    cands = unique_dim(dim.select(F.lower(F.trim("name")).alias("lname"), "ordinal", F.col("id").cast("string").alias("id")),
                       "lname", "ordinal")
    best = best_matches(names, cands, common).select(F.col("q").alias("_bq"), F.col("best").alias("_best"))
    exact = cands.select(F.col("lname").alias("_eq"), F.col("id").alias("_exact"))
    out = df.withColumn("_q", q)
    out = out.join(best, F.col("_q") == F.col("_bq"), "left").join(exact, (F.col("_q") == F.col("_eq")) & (F.col("_q") != ""), "left")
    return (out.withColumn(f"{prefix}_id", F.coalesce(F.col("_exact"), F.col("_best.id")))
               .withColumn(f"{prefix}_match", F.when(F.col("_exact").isNotNull(), F.lit("exact"))
                           .when(F.col("_best").isNotNull(), F.lit("fuzzy")))
               .withColumn(f"{prefix}_score", F.when(F.col("_exact").isNull(), F.col("_best.score")))
               .drop("_q", "_bq", "_eq", "_best", "_exact"))

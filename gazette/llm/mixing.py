"""Mixing sources to target weights by Poisson replication.

A source's rows are repeated at a mean rate that takes the source to its target share.  A document's count
is the inverse of the Poisson distribution with that mean at a number in [0, 1) hashed from its id and text, so a
rerun gives the same copies and documents that share an id, or have none, are drawn on their own.  Copies are exploded and shuffled by a hashed key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import small_side

MEAN_PER_DRAW = 64.0  # a larger mean is the sum of equal independent draws, each with a short table


def uniform(key: Column) -> Column:
    """[0, 1) from 52 bits of MD5."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_table(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable, as far as doubles tell them apart."""
    last = F.ceil(mean + F.sqrt(mean) * 12 + 30).cast("int")
    first = F.exp(-mean)
    walk = F.aggregate(
        F.sequence(F.lit(1), last), F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all")),
        lambda s, k: F.struct((s["p"] * mean / k).alias("p"), (s["c"] + s["p"] * mean / k).alias("c"),
                              F.concat(s["all"], F.array(s["c"] + s["p"] * mean / k)).alias("all")))
    return walk["all"]


def source_rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None,
                 power: float = 0.5, epochs: float = 1.0) -> tuple[DataFrame, int]:
    """(source, n, rate, draws, cdf) per source, and how many sources there are.

    A source's weight is ``weights[source]`` (1 if not listed); without ``weights`` it is its row count to
    ``power``, in thousandths.  rate = epochs * rows of all sources * (weight / sum of weights) / its rows.
    """
    counts = docs.groupBy(docs[source_col].alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.round(F.pow(F.col("n").cast("double"), F.lit(power)) * 1000).cast("long")
    else:
        listed = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
        weight = F.coalesce(F.round(listed[F.col("source")] * 1000), F.lit(1000)).cast("long") if weights else F.lit(1000)
    counts = counts.withColumn("w", weight)
    n, w, k = counts.agg(F.sum("n"), F.sum("w"), F.count(F.lit(1))).first()
    rate = (F.lit(float(n or 0)) * F.col("w").cast("double") * F.lit(epochs)) / (F.lit(float(w or 1)) * F.col("n").cast("double"))
    rates = (counts.withColumn("rate", rate)
             .withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MEAN_PER_DRAW).cast("int")))
             .withColumn("cdf", poisson_table(F.col("rate") / F.col("draws"))))
    return rates.select("source", "n", "rate", "draws", "cdf"), k


def poisson_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                weights: dict[str, float] | None = None, power: float = 0.5, epochs: float = 1.0,
                seed: int = 5, carry: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """One row per copy of a document: <id_col>, source, copy (from 1), copies, rate, shuffle_key, and with
    ``carry`` a struct ``carried``; dealt over tasks and ordered in each by the hashed ``shuffle_key``.

    A null source is a source of its own; a null id is hashed as the word null, a null text as an empty one.  Rows of equal
    id and text get equal counts; their copies are told apart by nothing but ``copy``.  A
    table without ``text_col`` is drawn by ids alone.  Documents with a count of 0 leave.  No rows give no rows.  Other columns are ignored.
    """
    rates, sources = source_rates(docs, source_col, weights, power, epochs)
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"),
                       F.md5(F.coalesce(docs[text_col].cast("string"), F.lit("")) if text_col in docs.columns else F.lit("")).alias("hash"),
                       F.struct(*[docs[c] for c in carry or []]).alias("carried") if carry else F.lit(None).alias("carried"))
    rates = small_side(rates.withColumnRenamed("source", "rate_source"), sources)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(":"), F.col("hash"))
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("draws")), F.lit(0),
        lambda total, j: total + F.size(F.filter("cdf", lambda c: c <= uniform(F.concat(name, F.lit("#"), j.cast("string"))))))
    drawn = (rows.join(rates, F.col("source").eqNullSafe(F.col("rate_source")))
             .withColumn("u", uniform(F.concat(name, F.lit("#1"))))
             .withColumn("copies", F.when(F.col("draws") == 1, F.size(F.filter("cdf", lambda c: c <= F.col("u")))).otherwise(count)))
    copies = drawn.filter("copies > 0").select(
        "id", "hash", "source", "carried", "copies", "rate", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    key = F.md5(F.concat(name, F.lit("/"), F.col("copy").cast("string")))
    out = (copies.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
           .select(F.col("id").alias(id_col), "source", F.col("copy").cast("long").alias("copy"),
                   F.col("copies").cast("long").alias("copies"), "rate", "shuffle_key", "carried"))
    return out if carry else out.drop("carried")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **how) -> DataFrame:
    """The copies, with the columns of ``docs``."""
    return poisson_mix(docs, id_col, source_col, carry=docs.columns, **how).select("carried.*")

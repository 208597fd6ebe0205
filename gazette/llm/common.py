"""Helpers shared by the training-data operators."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names and that every executor sees.

    Unset, it is only made up for a session whose tasks run in the driver's own process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def array_literal(rows: list[dict], schema: str) -> Column:
    """A constant array of structs, folded to one literal by the optimizer."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<{schema}>")


def lower_bound(sorted_array: Column, n: int, key: Column) -> Column:
    """How many of the n entries of ``sorted_array`` are <= ``key``: a binary search in the row."""
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(max(1, n.bit_length()))), F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(_halved(s, sorted_array, key)))
    return step["lo"] if n else F.lit(0)


def _halved(s: Column, sorted_array: Column, key: Column) -> Column:
    mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    right = F.get(sorted_array, mid) <= key
    return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"),
                    F.when(right, s["hi"]).otherwise(mid).alias("hi"))


def evenly(values: list, n: int) -> list:
    """At most n - 1 splitters that deal sorted ``values`` out evenly, each once."""
    cut = [values[len(values) * i // n] for i in range(1, n)] if values else []
    return [v for i, v in enumerate(cut) if i == 0 or v != cut[i - 1]]


def small_side(df: DataFrame, rows: int, most: int = 10_000) -> DataFrame:
    """``df`` with a broadcast hint only where its counted rows are within the bound."""
    return F.broadcast(df) if rows <= most else df

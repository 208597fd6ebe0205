"""The corpus pipeline: documents through language ID, exact dedup, near dedup, mixing and packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again
as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.common import shared_dir, table
from gazette.llm.exact_dedup import dedup
from gazette.llm.langid import UNKNOWN, identify, learn
from gazette.llm.mixing import mix
from gazette.llm.packing import pack
from gazette.llm.queries import END_ID, WORD_BPE, tokenizer_file
from gazette.llm.simhash import keep_one

LEAST_SCORE = 0.4  # mean probability of the predicted language; mixed texts of two languages stay above it


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter and texts that no language fits go."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    judged = identify(docs, learn(docs.filter(F.coalesce(~held_out, F.lit(False)))))
    return judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, words=3, distance=2)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_file(WORD_BPE), end_id=END_ID)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixed", mixed), ("packed", packed)]

#: SQL can express neither the language model nor the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

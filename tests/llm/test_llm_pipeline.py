"""The pipeline's stages on their own inputs."""
import zlib
from collections import Counter

import corpus_pipeline as CP
from pyspark.sql import functions as F

from test_llm_dedup import brute_components, brute_simhash, lower

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    junk = spark.createDataFrame([(5000, "12 | 34 --", "en", "src0", 10), (5001, None, None, None, None), (5002, "", "de", "src0", 0)], docs.schema)
    docs = docs.union(junk)
    rows = {}
    for name, stage in CP.STAGES:
        before = docs.collect()
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = docs.collect()
        rows[name] = after
        if name != "packed":
            assert docs.columns == COLUMNS
        if name == "language":
            gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
            assert {5000, 5001, 5002} <= gone and len(gone) < 8
        elif name == "exact":
            least = {}
            for r in before:
                t = lower(r["text"])
                least[t] = min(r["doc_id"], least.get(t, r["doc_id"]))
            assert sorted(r["doc_id"] for r in after) == sorted(least.values())
        elif name == "near":
            fps = [brute_simhash(r["text"]) for r in before]
            root = brute_components(fps)
            least = {}
            for r, f in zip(before, fps):
                least[root[f]] = min(r["doc_id"], least.get(root[f], r["doc_id"]))
            assert sorted(r["doc_id"] for r in after) == sorted(least.values())
        elif name == "mixed":
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
            texts = {r["doc_id"]: r["text"] for r in before}
            assert all(texts[r["doc_id"]] == r["text"] for r in after)
            assert 0.85 < len(after) / len(before) < 1.15
        else:
            copies = Counter(r["doc_id"] for r in before)
            tokens = {}
            for r in after:
                tokens.setdefault(r["doc_id"], []).append(r["length"])
                assert r["offset"] + r["length"] <= 4096
            assert set(tokens) == set(copies)
            whole = {r["doc_id"]: r["doc_tokens"] for r in after}
            assert all(sum(tokens[i]) == copies[i] * whole[i] for i in copies)
            used = {}
            for r in after:
                used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            for parts in used.values():
                at = 0
                for off, n in sorted(parts):
                    assert off == at
                    at += n


def test_odd_documents_pass_all_stages(spark, odd, none, tmp_path):
    for kind, docs in (("odd", odd), ("none", none)):
        for name, stage in CP.STAGES:
            out = stage(spark, docs, "")
            if name != "packed":
                assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{kind}-{name}")
            if name != "packed":
                docs = spark.read.parquet(f"{tmp_path}/{kind}-{name}")


def test_run_equals_the_stages(spark):
    got = CP.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and zlib.crc32(b"") == 0
    assert got.filter(F.col("length") <= 0).count() == 0

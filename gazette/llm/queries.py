"""The registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions.text import let
from gazette.llm.common import table
from gazette.llm.url_filter import Rule

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
END_ID = 2

RULES = [Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn
    return register


@query("op1_iblt_fingerprints")
def op1_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazette.llm.iblt import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


def _op2_sql() -> str:
    from gazette.llm.url_filter import SOFT, STRICT

    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hit = "regexp_matches(scanned, '(^|[^a-z0-9]){}($|[^a-z0-9])')::BIGINT"
    count = lambda terms: " + ".join(hit.format(t) for t in terms)
    weight = " + ".join(f"{hit.format(t)} * {w}" for t, w in (STRICT | SOFT).items())
    fits = lambda r: (f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))")
    longest = sorted(RULES, key=lambda r: -len(str(r)))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for r in longest)
    action = " ".join(f"WHEN {fits(r)} THEN '{r.action}'" for r in longest)
    return f"""
WITH u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, {lower.format("regexp_extract(coalesce(rest, ''), '^[^/?#]*')")} AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path,
             {lower.format("coalesce(rest, url, '')")} AS scanned FROM u),
t AS (SELECT *, {count(STRICT)} AS strict_hits, {count(SOFT)} AS soft_hits, round({weight}, 6)::DOUBLE AS weight FROM h)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {action} WHEN strict_hits > 0 OR soft_hits >= 2 THEN 'block' ELSE 'allow' END AS verdict, strict_hits, soft_hits, weight
FROM t"""




@query("op2_url_vocabulary", _op2_sql())
def op2_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazette.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), rules=RULES)


@query("op3_warc_dictionary", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f""")
def op3_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazette.llm.warc import archived

    return archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_content_sort", """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
           FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)""")
def op4_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazette.llm.exact_dedup import content_sort

    return content_sort(table(spark, sf_dir, "documents"), keep="largest")


@query("op5_poisson_mix", """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n, round(sqrt(count(*)::DOUBLE) * 1000)::BIGINT AS w FROM documents GROUP BY source),
rates AS (SELECT source, n, ((SELECT sum(n) FROM counts)::DOUBLE * w::DOUBLE * 1.0) / ((SELECT sum(w) FROM counts)::DOUBLE * n::DOUBLE) AS rate
          FROM counts),
cdf AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
        UNION ALL
        SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + sqrt(rate) * 12 + 30)),
named AS (SELECT doc_id, source, '5:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) AS name FROM documents),
drawn AS (SELECT doc_id, source, name, ('0x' || substr(md5(name || '#1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM named),
counted AS (SELECT doc_id, drawn.source, name, any_value(rate) AS rate, count(*) FILTER (c <= u) AS copies
            FROM drawn JOIN cdf ON drawn.source IS NOT DISTINCT FROM cdf.source GROUP BY doc_id, drawn.source, name)
SELECT doc_id, source, copy, copies, rate, md5(name || '/' || copy::VARCHAR) AS shuffle_key
FROM (SELECT *, unnest(generate_series(1, copies)) AS copy FROM counted WHERE copies > 0)""")
def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazette.llm.mixing import poisson_mix

    return poisson_mix(table(spark, sf_dir, "documents"))


@query("op6_harmonic_packing")
def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazette.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file(WORD_BPE), end_id=END_ID)


@query("op7_sentence_spans")
def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazette.llm.sentence_spans import remove_spans

    return remove_spans(table(spark, sf_dir, "documents"))


@query("op8_language_crf")
def op8_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazette.llm.langid import identify, learn

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    field = learn(docs.filter(~held_out))
    judged = identify(docs.select("doc_id", "text", held_out.alias("held_out")), field)
    return judged.select("row.doc_id", "row.held_out", "lang_pred", "score")


@query("op9_log_bilinear")
def op9_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazette.llm.lm import score_texts

    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 != 2)


@query("op10_gray_index")
def op10_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazette.llm.simhash import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"))


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazette.llm.token_alignment import align_tokens

    found = align_tokens(table(spark, sf_dir, "documents"), tokenizer_file(BYTE_BPE), tokenizer_file(PIECE_BPE), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


@query("op12_token_counts")
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazette.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file(BYTE_BPE), limit=1024)


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text; one document in ten (by h = crc32 of doc_id) repeats, from word g % n on, its next
    1 + floor((n - a) / (3 + g % 8)) words, where g = floor(h / 10).  A null doc_id leaves the text as it is."""
    h = F.crc32(docs["doc_id"].cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        at = lambda a: let(1 + F.floor((n - a) / (3 + g % 8)), lambda p: F.array_join(F.transform(
            words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " "))
        return F.when(n > 0, let(g % F.greatest(n, F.lit(1)), at)).otherwise("")

    words = F.filter(F.split(docs["text"], r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.select("doc_id", F.when(h % 10 == 0, let(words, repeated)).otherwise(docs["text"]).alias("text"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gazette.llm.periodic_runs import periodic_runs

    found = periodic_runs(looped(table(spark, sf_dir, "documents")))
    stronger = lambda x, y: y["length"] * x["period"] > x["length"] * y["period"]
    best = F.aggregate("runs", F.get("runs", 0), lambda x, y: F.when(stronger(x, y), y).otherwise(x))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))

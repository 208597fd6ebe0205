"""URL vocabulary and WARC archives."""
import hashlib
import io
import random
import re

from pyspark.sql import functions as F

from gazette.llm import warc
from gazette.llm.queries import RULES
from gazette.llm.url_filter import SOFT, STRICT, Judge, Rule, Vocabulary, judge_urls, split_url


def brute(url):
    host, path, scanned = split_url(url)
    hit = lambda t: bool(re.search(rf"(?<![^\W_]){re.escape(t)}(?![^\W_])", scanned))
    strict, soft = sum(map(hit, STRICT)), sum(map(hit, SOFT))
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(str(r)), default=None)
    return (host, path, str(rule) if rule else None, rule.action if rule else "block" if strict or soft >= 2 else "allow", strict, soft)


URLS = ["http://WWW.Example.NET/en/1", "https://a.example.com/de/x?y#z", "http://example.com/de", "x://org/fr/", "nothing", "", None, "a://b",
        "http://free-porn.example.org/", "http://x.org/sexy/hot-girls", "http://x.org/essex/hotel", "HTTP://X.ORG/SEX%20", "http://x.org?casino&poker",
        "http://casino_poker.org/", "http://x.org/hot/hot/hot", "http://badexample.net/", "http://net/", "http://net", "a://b://c/d", "://x.net/q",
        "http://x.org/écasino/poker", "http://x.org/\nporn\n", "http://e.org/" + "a" * 5000 + "/xxx"]


def test_urls(spark, none):
    judge = Judge(Vocabulary(), RULES)
    for u in URLS:
        assert judge(u)[:6] == brute(u), u
    df = spark.createDataFrame([(k, u) for k, u in enumerate(URLS * 2)] + [(None, "http://x.net/"), (1, None)], "page_id long, url string")
    df = df.withColumn("host", F.lit(1)).withColumn("verdict", F.lit("x"))
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["strict_hits"], r["soft_hits"]) for r in judge_urls(df, rules=RULES).collect()}
    assert got == {(r["page_id"], *brute(r["url"])) for r in df.select("page_id", "url").collect()}
    assert judge_urls(df).count() == df.count()
    assert judge_urls(df.limit(0)).count() == 0


def test_longest_rule_wins():
    judge = Judge(Vocabulary({}, {}), [Rule("block", "a.b"), Rule("allow", "a.b", "/x/"), Rule("block", "c.a.b", "/x/")])
    assert [judge(u)[3] for u in ("q://a.b/", "q://z.a.b/x/y", "q://c.a.b/x/", "q://b/")] == ["block", "allow", "block", "allow"]


def brute_records(rows):
    first = {}
    for i, _, p in rows:
        if i is not None:
            first[p or ""] = min(i, first.get(p or "", i))
    out = []
    for i, _, p in rows:
        b = (p or "").encode()
        again = len(b) >= 100 and (p or "") in first and i != first[p or ""]
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[p or ""] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, documents, tmp_path):
    big = "né" * 400_000
    rows = [(1, "http://a/", "x" * 99), (2, "http://a/%0A\r\nb", "x" * 99), (3, None, "y" * 100), (4, "u", "y" * 100), (4, "u", "y" * 100), (3, "v", "y" * 100),
            (5, "", None), (6, "", ""), (None, "w", "y" * 100), (7, "big", big), (8, "big", big), (9, "q", "a\r\n\r\nWARC/1.1\r\n" * 20)]
    rows += [(100 + r["doc_id"], "http://d/", r["text"]) for r in documents.collect()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit(0)).withColumn("digest", F.lit("x"))
    for size in (1 << 25, 1 << 14):
        got = warc.archived(df, archive_bytes=size).collect()
        assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute_records(rows)
    manifest = warc.write_warc(df, f"file://{tmp_path}", archive_bytes=1 << 20)
    back = {(r["page_id"], r["url"], bytes(r["payload"]).decode()) for r in warc.read_warc(manifest, f"file://{tmp_path}").filter("record_type = 'response'").collect()}
    assert ("9", "q", "a\r\n\r\nWARC/1.1\r\n" * 20) in back and ("2", "http://a/%0A\r\nb", "x" * 99) in back
    assert warc.archived(df.limit(0)).count() == 0


def test_dictionary_leads_the_archive():
    rng = random.Random(2)
    made = [warc.record(str(k), f"http://h/{k}", (p := ("<p>" + " ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(60))).encode()),
                        len(p), hashlib.sha256(p).hexdigest(), None, "2000-01-01T00:00:00Z") for k in range(2000)]
    out, plain = io.BytesIO(), io.BytesIO()
    warc.write_archive(out, made, 3, 4096, 1 << 20)
    warc.write_archive(plain, made, 3, 1 << 30, 1 << 20)
    data = out.getvalue()
    assert data[:4] == b"\x5d\x2a\x4d\x18" and plain.getvalue()[:4] != data[:4]
    assert len(data) < 0.8 * len(plain.getvalue())
    for buf in (out, plain):
        got = list(warc.read_archive(io.BytesIO(buf.getvalue())))
        assert [h["WARC-Record-ID"] for h, _ in got] == [f"<urn:page:{k}>" for k in range(2000)]
    frames = data.count(b"\x28\xb5\x2f\xfd")
    assert frames >= 2000

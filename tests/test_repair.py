"""S4 equals a plain transcription of the repair rule on every prefix of a document."""
import json

from pyspark.sql import functions as F

from gazette.sources.responses import read_responses, repair_truncated_json


def repair_reference(s: str) -> str:
    s = s.rstrip(", ")
    stack, in_str, esc = [], False, False
    for ch in s:
        if esc:
            esc = False
            continue
        if ch == "\\" and in_str:
            esc = True
            continue
        if ch == '"':
            in_str = not in_str
            continue
        if in_str:
            continue
        if ch == "{":
            stack.append("}")
        elif ch == "[":
            stack.append("]")
        elif ch in "}]":
            if stack:
                stack.pop()
    return s + ('"' if in_str else "") + "".join(reversed(stack))


DOC = json.dumps({"title": "SSC \"CGL\" 2025", "tags": ["a", "b\\c"], "links": [{"t": "x", "u": "https://a/b"}],
                  "n": 12, "ok": True, "faq": [{"q": "Q?", "a": "A, [b] {c}"}]})


def test_repair_all_prefixes(spark):
    prefixes = [DOC[:i] for i in range(1, len(DOC) + 1)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prefixes)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(repair_truncated_json(F.col("s"))).collect()]
    assert got == [repair_reference(p) for p in prefixes]


def test_read_responses_statuses(spark):
    rows = [(1, "```json\n" + DOC + "\n```"), (2, DOC[:40]), (3, "not json"), (4, DOC[:9])]
    df = spark.createDataFrame(rows, "response_id long, body string")
    got = {r.response_id: (r.parse_status, r.title) for r in read_responses(df).collect()}
    assert got[1] == ("parsed", 'SSC "CGL" 2025')
    assert got[2][0] == "repaired"
    assert got[3] == ("rejected", None)
    assert got[4][0] in ("repaired", "rejected")


def test_repair_of_any_text(spark):
    import random
    rng = random.Random(11)
    parts = ['"', '"', "\\", '\\"', "\\\\", "{", "}", "[", "]", ",", " ", ":", "a", "é", "\n", '"a"', "[[", "]]"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(4000)] + ["[" * 30 + "]" * 12, '{"a' + '\\"' * 20_000, "\\", '"\\']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(repair_truncated_json(F.col("s"))).collect()]
    assert [(t, g) for t, g in zip(texts, got) if g != repair_reference(t) and not t.endswith("\n")] == []


def test_an_answer_is_built_once(spark):
    """The test for whole answers was pushed below the answer, which every use of it then built again."""
    from gazette.plans.registry import load_all
    from helpers import SF_SMALL
    plan = load_all()["s4_repair_truncated_json"][0](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("to_json") <= 2, plan.count("to_json")

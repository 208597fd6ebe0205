"""A date's parts are cut out once, and R3 reads the last date once."""
from pyspark.sql import functions as F

from gazette.functions import rules
from gazette.operators import normalize as N
from gazette.operators import reshape as R


def times(df, word: str) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count(word)


def test_a_part_of_a_date_is_cut_out_once(spark):
    df = spark.createDataFrame([("1 June 2026",), ("31/12/2025",), ("13/13/2025",), ("20260230",), ("Mon, 2nd feb 2026 10:30",), ("2026-0-1",), (None,)], "d string")
    assert times(df.select(N.parse_date("d").alias("z")), "regexp_extract(") == 3 * len(rules.DATE_FORMS)
    assert [r[0] for r in df.select(N.parse_date("d").cast("string")).collect()] == ["2026-06-01", None, None, "2026-03-02", "2026-02-02", None, None]


def test_the_last_date_is_read_once(spark):
    names = ["notification_date", "start_date", "last_date", "interview_date_from", "exam_date", "result_date", "waitlist_date"]
    df = spark.createDataFrame([(1, *["1 June 2026"] * 7, "4 PM")], ["post_id", *names, "deadline_time"])
    rows = R.date_rows(df)
    assert times(rows, "make_date(") == len(names) * len(rules.DATE_FORMS)
    assert [(r["label"], r["value"]) for r in rows.filter(F.col("label").isin("Apply Last Date", "Fee Payment Deadline")).orderBy("row_no").collect()] == [
        ("Apply Last Date", "01-06-2026 (by 4 PM)"), ("Fee Payment Deadline", "01-06-2026")]

"""Postings are made by many tasks, whatever the number of files, and their contents are not shuffled by type."""
import glob

from helpers import SF_SMALL
from pyspark.sql import functions as F

from gazette.operators import normalize as N
from gazette.operators import reshape as R
from gazette.plans.fixtures import load_postings_raw
from gazette.sources.sinks import write_postings


def test_one_file_of_orders_is_the_work_of_many_tasks(spark):
    made = load_postings_raw(spark, SF_SMALL).select("post_id", "title")
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_a_task_writes_its_own_rows_by_type(spark, tmp_path):
    rows = spark.range(60).select(F.col("id").alias("post_id"), F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("type")).coalesce(1)
    write_postings(rows, rows.filter("post_id = 1"), str(tmp_path))
    assert sorted(f.split("/")[-2] for f in glob.glob(f"{tmp_path}/postings/*/*.zstd.parquet")) == ["type=t0", "type=t1", "type=t2"]
    assert spark.read.parquet(f"{tmp_path}/postings").count() == 60 and spark.read.parquet(f"{tmp_path}/quarantine").count() == 1


def test_a_deadline_is_worked_out_once(spark):
    df = spark.createDataFrame([("1 June 2026", "4 PM"), ("", "4 PM"), ("2026-06-01", "")], "d string, t string")
    got = df.select(N.deadline_text_table("d", "t").alias("t"), N.deadline_text("d", "t").alias("q"))
    assert [tuple(r) for r in got.collect()] == [("01-06-2026 (by 4 PM)", "01-06-2026 by 4 PM"), (N.NO_DATE, "Apply Soon by 4 PM"), ("01-06-2026", "01-06-2026")]
    dates = [df.select(c.alias("z"))._jdf.queryExecution().optimizedPlan().toString().count("make_date")
             for c in (N.safe_date("d"), N.deadline_text_table("d", "t"), N.deadline_text("d", "t"))]
    assert dates[0] == dates[1] == dates[2]
    assert R.date_rows(load_postings_raw(spark, SF_SMALL)).filter(F.col("value").isNull()).isEmpty()

"""Shared by the tests of every folder; a module name that no conftest shadows."""

import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF_SMALL = "/root/testdata/sf0.001"


def one_col(spark, values, expr_fn, schema="v string"):
    """Evaluate a column expression over a list of single values; returns the results in order."""
    from pyspark.sql import functions as F
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(expr_fn(F.col(schema.split()[0]))).collect()]

"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None).

Every builder takes (spark, sf_dir) and reads the supplied tables (or data
Spark derives from them), so its work grows with the tables.  Result columns
are scalars with identical names and types on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict:
    # importing the modules fills REGISTRY
    from gazette.plans import queries_pages  # noqa: F401
    from gazette.plans import queries_postings  # noqa: F401
    from gazette.plans import queries_responses  # noqa: F401
    from gazette.plans import queries_streaming  # noqa: F401
    return REGISTRY

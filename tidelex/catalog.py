"""All queries of the library by name, with DuckDB SQL for the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "axis_series"


def query(sql: str | None = None):
    """Register a function under its name, with SQL for the same columns and rows."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


from tidelex.plans import curation, filings, model_queries, page_queries, reports, series, statistics, stories, text_queries  # noqa: E402, F401

"""All named queries of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "heading_parse"


def query(sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) under its name, with SQL for DuckDB that must return the same rows."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


from . import block_queries, change_queries, format_queries, host_queries, shape_queries, sql_queries, structure_queries, text_queries  # noqa: E402, F401

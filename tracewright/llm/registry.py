"""All queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import queries_duplicates, queries_pii, queries_sizes

FAMILIES = [queries_pii, queries_duplicates, queries_sizes]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query by name."""
    return {k: v for m in FAMILIES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {k: v for m in FAMILIES for k, v in m.SQL.items()}

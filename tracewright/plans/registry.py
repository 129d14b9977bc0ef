"""All queries outside the subpackage for training text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.plans import core, imports, parsing, relations, risk, search, state, streams

FAMILIES = [core, search, parsing, risk, imports, state, relations, streams]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query by name."""
    return {k: v for m in FAMILIES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {k: v for m in FAMILIES for k, v in m.SQL.items()}

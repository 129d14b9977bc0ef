"""Queries of the operator that finds personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.pii import Finder, find_spans, learn, redact_columns
from tracewright.sources.scratch import settle, spread
from tracewright.sources.tables import load

FIELDS = ["notes", "resolution", "error_excerpt"]


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """seq, field, text of every filled field of every fix."""
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in FIELDS])).alias("e")
    rows = spread(load(spark, d, "fixes").select("seq", *FIELDS)).select("seq", fields).select("seq", "e.field", "e.text").where(F.length("text") > 0)
    return settle(rows, "fix-texts")


def _learned(spark: SparkSession, d: str, texts: DataFrame) -> Finder:
    return learn(texts, load(spark, d, "roster"), load(spark, d, "fixes").select("author"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The different pieces of personal data of every field of every fix."""
    texts = _texts(spark, d)
    return find_spans(texts, ["seq", "field"], _learned(spark, d, texts))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    """seq and the three fields, with typed placeholders in place of personal data."""
    texts = _texts(spark, d)
    return redact_columns(load(spark, d, "fixes").select("seq", *FIELDS), FIELDS, _learned(spark, d, texts))


QUERIES = {"p3_found": p3_found, "p3_redacted": p3_redacted}
SQL: dict[str, str] = {}

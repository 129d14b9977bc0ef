"""Parquet tables of one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` under ``directory`` (file or folder ``name.parquet``)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")

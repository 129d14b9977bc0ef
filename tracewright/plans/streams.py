"""Queries that run as Structured Streaming over all input there is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.sources.tables import load
from tracewright.streaming.errors import latest_status, open_sessions, parsed, run_to_end, windowed_counts


def _stream(spark: SparkSession, d: str, table: str) -> DataFrame:
    batch = load(spark, d, table)
    glob = f"{table}.parquet"
    return spark.readStream.schema(batch.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/{glob}*")


def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each error, kept as state across micro-batches."""
    changes = run_to_end(latest_status(_stream(spark, d, "pending_errors")), spark, "update")
    return changes.groupBy("error_id").agg(F.max_by(F.struct("seq", "status"), "seq").alias("r")).select("error_id", "r.*")


def stream_daily(spark: SparkSession, d: str) -> DataFrame:
    """Events per day and type, as windows complete up to the last row."""
    counts = windowed_counts(_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 day", "2 days")
    got = run_to_end(counts, spark, "update")
    last = got.groupBy(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type").agg(F.max_by("n", "epoch").alias("n"))
    return last


def stream_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Deferred errors made of a stream of excerpts."""
    rows = parsed(_stream(spark, d, "pending_errors").select("seq", "error_excerpt"), "error_excerpt", ["seq"])
    return run_to_end(rows, spark, "append").select("seq", "error_type", "error_code", "resource_address", "kind")


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of errors of a folder and command family that no pause of a day interrupts."""
    got = run_to_end(open_sessions(_stream(spark, d, "pending_errors")), spark, "append")
    return got.groupBy("cwd", "command_family").agg(F.count(F.lit(1)).alias("sessions"), F.sum("errors").alias("errors"))


QUERIES = {"stream_latest": stream_latest, "stream_daily": stream_daily, "stream_parsed": stream_parsed, "stream_sessions": stream_sessions}
SQL = {
    "stream_latest": "SELECT error_id, seq, status FROM pending_errors QUALIFY row_number() OVER (PARTITION BY error_id ORDER BY seq DESC)=1",
    "stream_daily": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY 1,2",
}

"""Streams of tool output and of deferred errors: the same functions as in batch, with state kept by the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.text import instant_us
from tracewright.operators.parse import parse_errors, to_pending
from tracewright.sources.scratch import scratch_path

#: How long a session may still be resolved, and how late its errors may come.
SESSION_TTL = "24 hours"


def event_time(c: Column) -> Column:
    """A deferral's time as a timestamp; null for unreadable ones, which a watermark passes over."""
    return F.timestamp_micros(instant_us(c))


def latest_status(stream: DataFrame) -> DataFrame:
    """error_id, seq, status of each error's last row, in update mode: last write wins. Merged on the map side, no Python."""
    best = F.max(F.struct("seq", "status")).alias("r")
    return stream.groupBy("error_id").agg(best).select("error_id", "r.*")


def latest_status_within(stream: DataFrame, late: str = SESSION_TTL, width: str = "1 day") -> DataFrame:
    """As ``latest_status`` per day of deferral, so that state is dropped once the watermark passes a day."""
    timed = stream.withColumn("at", event_time(F.col("deferred_at"))).withWatermark("at", late)
    return timed.groupBy("error_id", F.window("at", width)).agg(F.max(F.struct("seq", "status")).alias("r")).select("error_id", F.col("window.start").alias("day"), "r.*")


def open_sessions(stream: DataFrame, gap: str = SESSION_TTL) -> DataFrame:
    """cwd, command_family, session window, errors and the newest session id; what is late is ignored, what is old is dropped from state."""
    timed = stream.withColumn("at", event_time(F.col("deferred_at"))).withWatermark("at", gap)
    newest = F.max(F.struct("at", "seq", "session_id")).alias("last")
    return timed.groupBy("cwd", "command_family", F.session_window("at", gap)).agg(F.count(F.lit(1)).alias("errors"), newest).select("cwd", "command_family", F.col("session_window.start").alias("began"), "errors", "last.session_id")


def parsed(stream: DataFrame, text: str, keep: list[str], fallback: Callable[[Column], Column] = lambda t: F.left(t, F.lit(120))) -> DataFrame:
    """Deferred errors of a stream of outputs. Parsing keeps no state; an output in which nothing is found gives one generic row."""
    marked = stream.withColumn("__raw", F.col(text))
    errors = to_pending(parse_errors(marked, text), [*keep])
    nothing = stream.where(F.col(text).isNotNull() & ~F.col(text).rlike(r"Error|error|ERROR|CrashLoopBackOff|OOMKilled|ImagePullBackOff|ErrImagePull|CreateContainerConfigError|Pending|FailedScheduling|Unhealthy|INSTALLATION FAILED|UPGRADE FAILED"))
    generic = nothing.select(*keep, F.lit("unknown").alias("error_type"), fallback(F.col(text)).alias("short_message"), F.left(F.col(text), F.lit(2000)).alias("error_excerpt"), F.lit("resource").alias("kind"))
    return errors.unionByName(generic, allowMissingColumns=True)


def windowed_counts(stream: DataFrame, time: str, group: str, width: str, late: str) -> DataFrame:
    """Rows per window and group; rows later than ``late`` are ignored."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), group).agg(F.count(F.lit(1)).alias("n"))


def run_to_end(stream: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    """Runs a stream over all input there is, and returns what it wrote, with the micro-batch as ``epoch``."""
    out = scratch_path(spark, "stream")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")  # a repeated micro-batch replaces itself

    schema = T.StructType([*stream.schema.fields, T.StructField("epoch", T.IntegerType())])
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", scratch_path(spark, "stream-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(out)

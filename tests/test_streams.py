import datetime as dt

from pyspark.sql import functions as F

from tracewright.streaming.errors import latest_status_within, open_sessions, parsed, run_to_end

ROWS = "seq long, error_id string, status string, deferred_at string, cwd string, command_family string, session_id string, text string"


def stream(spark, path, *batches):
    """A file for each batch, read one by one."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(path)
        assert i >= 0
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(path)


def row(seq, day, hour=0, error="e", status="pending", text=None):
    return (seq, error, status, dt.datetime(2025, 1, day, hour).isoformat(), "c", "f", f"s{seq}", text)


def test_late_rows_are_ignored_and_old_state_dropped(spark, tmp_path):
    # Lateness is told from the batch before last, so the late row comes in the batch after the second one of day 9.
    rows = stream(spark, f"{tmp_path}/in", [row(1, 1), row(2, 1, 5, status="resolved")], [row(3, 9)], [row(4, 9, 2)], [row(5, 1, 6, status="late"), row(6, 9, 1, status="superseded")], [row(7, 20)])
    got = run_to_end(latest_status_within(rows), spark, "append").collect()
    assert {(r.day.day, r.seq, r.status) for r in got} == {(1, 2, "resolved"), (9, 6, "superseded")}


def test_sessions(spark, tmp_path):
    rows = stream(spark, f"{tmp_path}/in", [row(1, 1, 0), row(2, 1, 20), row(3, 5, 0)], [row(4, 20)], [row(5, 29)])
    got = run_to_end(open_sessions(rows), spark, "append").collect()
    assert sorted((r.began.day, r.errors, r.session_id) for r in got) == [(1, 2, "s2"), (5, 1, "s3"), (20, 1, "s4")]


def test_parsed_outputs(spark, tmp_path):
    rows = stream(spark, f"{tmp_path}/in", [row(1, 1, text="Error: AccessDenied on it\n  with aws_s3_bucket.b,"), row(2, 1, text="it just stopped"), row(3, 1)])
    got = {r.seq: r for r in run_to_end(parsed(rows.select("seq", "text"), "text", ["seq"]), spark, "append").select("seq", "error_type", "error_code", "short_message", F.col("resource_address").alias("a")).collect()}
    assert (got[1].error_type, got[1].error_code, got[1].a) == ("terraform", "AccessDenied", "aws_s3_bucket.b")
    assert (got[2].error_type, got[2].short_message) == ("unknown", "it just stopped") and set(got) == {1, 2}

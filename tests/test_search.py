from pyspark.sql import functions as F

from tracewright.operators.search import cluster_key, keywords
from tracewright.plans.search import history_best, similar_topk


def test_cluster_key(spark):
    want = {
        "Pod in CrashLoopBackOff after ThrottledCaller": "CrashLoopBackOff",
        "Access  denied: for \trole, on bucket": "access denied for role",
        "Über-Quota hit": "überquota hit",
        " x": "x",
        "": "",
        None: "",
    }
    rows = spark.createDataFrame([(k,) for k in want], "issue string")
    assert {r.issue: r.k for r in rows.select("issue", cluster_key(F.col("issue")).alias("k")).collect()} == want


def test_history_best(spark, tmp_path):
    t = "2024-01-01T00:00:00Z"
    rows = [(1, "a CrashLoopBackOff", t, "x"), (2, "b CrashLoopBackOff", t, "x"), (3, "c CrashLoopBackOff", "2025-01-01T00:00:00Z", None), (4, "one, two  three four five", t, None)]
    spark.createDataFrame(rows, "seq long, issue string, created_at string, error_excerpt string").write.parquet(f"{tmp_path}/fixes.parquet")
    got = {(r.cluster, r.seq, r.n) for r in history_best(spark, str(tmp_path)).collect()}
    assert got == {("CrashLoopBackOff", 1, 3), ("one two three four", 4, 1)}


def test_all_stop_words_are_left_out(spark, tmp_path):
    rows = [(100, "while above quota may fail", "")] + [(i, f"while above may x{i}y", "") for i in range(1, 4)] + [(9, "Quota once: before", "")]
    df = spark.createDataFrame(rows, "seq long, issue string, tags string")
    assert df.where("seq = 9").select(keywords(F.col("issue"))).first()[0] == ["quota"]
    df.write.parquet(f"{tmp_path}/fixes.parquet")
    assert [(r.item, r.shared, r.score) for r in similar_topk(spark, str(tmp_path)).collect()] == [(9, 1, 0.5)]

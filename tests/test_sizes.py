"""Work that must grow with the tables, not with the product of two: the most rows any step makes."""

import re

from pyspark.sql import functions as F

from tracewright.operators import plan as P
from tracewright.operators import risk as R
from tracewright.operators import similar as S

NOW = 1_767_225_600_000_000
N = 1200  # of each table; all have one type, so that every pair has something in common


def most_rows(spark, work):
    """What ``work`` returns, and the most rows that a step of any of its executions made."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    out = work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList()
    most = 0
    for i in range(before, runs.size()):
        values = store.executionMetrics(runs.apply(i).executionId())
        names = {m.accumulatorId() for m in (runs.apply(i).metrics().apply(k) for k in range(runs.apply(i).metrics().size())) if m.name() == "number of output rows"}
        for a in names:
            if values.contains(a):
                most = max(most, int(re.sub(r"\D", "", values.apply(a).split("(")[0]) or 0))
    assert most > 0
    return out, most


def tables(spark):
    ids = spark.range(N)
    rows = ids.select(F.concat(F.lit("p"), F.col("id")).alias("plan"), F.lit(1).alias("ord"), F.concat(F.lit("aws_iam_role.r"), F.col("id")).alias("address"), F.lit("aws_iam_role").alias("resource_type"), F.lit("-").alias("cloud_provider"), F.lit("update").alias("action"))
    empty = F.create_map().cast("map<string,string>")
    nodes = P.nodes(rows.withColumns({"before": empty, "after": F.create_map(F.lit("policy"), F.lit("1"))})).localCheckpoint()
    fixes = ids.select(
        F.col("id").alias("seq"), F.concat(F.lit("f"), F.lpad("id", 5, "0")).alias("id"), F.concat(F.lit("word"), F.col("id"), F.lit(" aws_iam_role.r"), F.col("id"), F.lit(" differs here")).alias("issue"), F.lit("changed its policy").alias("resolution"),
        F.lit("Error: Denied").alias("error_excerpt"), F.lit("aws_iam_role,iam").alias("tags"), F.lit("2024-01-01T00:00:00Z").alias("created_at"),
    ).localCheckpoint()
    return nodes, fixes


def test_relevant_fixes_make_no_pairs(spark):
    nodes, fixes = tables(spark)
    rows, most = most_rows(spark, lambda: R.relevant_fixes(nodes, fixes, "plan", NOW).collect())  # all: a filter would reach the tables
    got = sorted((r for r in rows if r["plan"] == 'p700'), key=lambda r: r.place)
    # All score as errors of the type (a code, 150); equals come in storage order.
    assert [(r.seq, r.score, r.signal, r.matched) for r in got] == [(i, 150, "error_code", 1) for i in range(10)]
    assert most < N * N / 10


def test_the_best_of_a_plan_come_from_different_nodes(spark):
    nodes, fixes = tables(spark)
    plain = fixes.withColumn("error_excerpt", F.lit("")).withColumn("tags", F.when(F.col("seq") % 2 == 0, "aws_iam_role"))
    both = nodes.withColumn("plan", F.lit("p")).withColumn("ord", F.substring("address", 15, 9).cast("int")).where("ord in (900, 901)")
    got = R.relevant_fixes(both, plain, "plan", NOW, 3).orderBy("place").collect()
    assert [(r.seq, r.score, r.signal, r.matched, r.resource) for r in got] == [(900, 120, "address", 2, "aws_iam_role.r900"), (901, 120, "address", 2, "aws_iam_role.r900"), (0, 100, "attribute", 2, "aws_iam_role.r900")]


def test_prior_fixes_make_no_pairs(spark):
    nodes, fixes = tables(spark)
    rows, most = most_rows(spark, lambda: R.prior_fixes(nodes, fixes, "plan").collect())  # all: a filter would reach the tables
    got = sorted((r for r in rows if r["plan"] == 'p700'), key=lambda r: r.place)
    assert [(r.seq, r.score, r.matched) for r in got] == [(i, 100, 1) for i in range(10)]
    assert most < N * N / 10


def test_type_counts_make_no_pairs(spark):
    nodes, fixes = tables(spark)
    got, most = most_rows(spark, lambda: R.type_counts(nodes, fixes, "plan").collect())
    assert {r.n for r in got} == {N} and len(got) == N
    assert most < N * N / 10


def test_history_prior_makes_no_pairs(spark):
    nodes, fixes = tables(spark)
    rows, most = most_rows(spark, lambda: R.history_prior(nodes, fixes, "plan").collect())  # all: a filter would reach the tables
    got = sorted((r for r in rows if r["plan"] == 'p700'), key=lambda r: r.place)
    assert [(r.place, r.seq) for r in got] == [(1, 0), (2, 1), (3, 2)]
    assert most < N * N / 10


def test_history_prior_reads_on_past_beaten_fixes(spark):
    """Fixes of one type that a newer one of another beats in the same cluster do not count, however many come first."""
    nodes, fixes = tables(spark)
    two = nodes.where("address = 'aws_iam_role.r0'").withColumn("address", F.lit("aws_iam_role.none"))
    two = two.unionByName(two.withColumn("resource_type", F.lit("aws_iam_user")).withColumn("address", F.lit("aws_iam_user.none")))
    few = fixes.where("seq < 40")
    newer = few.where("seq < 38").withColumn("seq", F.col("seq") + 100).withColumn("tags", F.lit("aws_iam_user,iam")).withColumn("created_at", F.lit("2025-01-01"))
    got = R.history_prior(two, few.unionByName(newer), "plan").orderBy("place").collect()
    assert [r.seq for r in got] == [38, 39, 100]


def test_similar_errors_make_no_pairs(spark):
    _, fixes = tables(spark)
    errors = fixes.select(F.col("seq").alias("query"), F.concat(F.lit("Error: Denied for aws_iam_role.r"), F.col("seq")).alias("text"), F.col("tags"), F.lit(None).cast("string").alias("address"))
    rows, most = most_rows(spark, lambda: S.similar_fixes(errors, fixes).collect())  # all: a filter would reach the tables
    got = sorted((r for r in rows if r["query"] == 700), key=lambda r: r.place)
    # Its own fix has the address too; those with the same words first in the alphabet are one kind of trouble.
    assert got[0].seq == 700 and [r.place for r in got] == [1, 2, 3, 4, 5] and [r.seq for r in got[1:]] == sorted(r.seq for r in got[1:])
    assert most < N * N / 10


def test_similar_errors_do_not_depend_on_blocks(spark, monkeypatch):
    _, fixes = tables(spark)
    errors = fixes.where("seq % 100 = 0").select(F.col("seq").alias("query"), F.col("issue").alias("text"), F.col("tags"), F.lit(None).cast("string").alias("address"))
    want = sorted(map(tuple, S.similar_fixes(errors, fixes, 20).collect()))
    monkeypatch.setattr(S, "FIX_BLOCK", 50)
    monkeypatch.setattr(S, "ERROR_BLOCK", 5)
    assert sorted(map(tuple, S.similar_fixes(errors, fixes, 20).collect())) == want and len(want) == 12 * 20
    assert S.similar_fixes(errors.limit(0), fixes).collect() == [] and S.similar_fixes(errors, fixes.limit(0)).collect() == []

import json

from pyspark.sql import functions as F

from tracewright.operators.shred import decode, find_member, own_tables, shred
from tracewright.plans.core import p5_found

CHANGE = {"address": "a.b", "change": {"actions": ["delete", "create"], "before": {"arn": "arn:x", "rule": [{"arn": "no"}]}, "after_unknown": {"arn": True}}}


def found(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "plan_id string, workspace string, payload string, received_at timestamp")
    df.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/plans.parquet")
    return sorted(tuple(r[c] for c in ("plan_id", "change_pos", "leaf", "leaf_pos", "leaf_value")) for r in p5_found(spark, str(tmp_path)).collect())


def test_decode():
    assert decode('{"a": 1}') == {"a": 1}
    assert decode(json.dumps(json.dumps([1]))) == [1]
    assert decode("text") == "text"
    assert decode('"text"') == '"text"'
    assert decode("{broken") == "{broken"
    assert find_member("﻿" + json.dumps({"x": [{"plan": json.dumps({"m": [1]})}]}), "m") == [1]
    assert find_member(None, "m") is None and find_member("", "m") is None and find_member("{}", "m") is None


def test_own_tables():
    graph = {("r", "a", False), ("a", "b", True), ("r", "s", False), ("a", "s", False), ("r", "t", False), ("t", "t2", False), ("t2", "t", False)}
    assert own_tables(graph, "r") == {"r", "b", "s", "t", "t2"}


def test_wrappings_and_shapes(spark, tmp_path):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    plan = {"resource_changes": [CHANGE, {"address": "c"}, {"change": {"actions": ["no-op"], "before": None, "after_unknown": {"arn": False}}}]}
    text_parts = {"resource_changes": [json.dumps(dict(CHANGE, change=json.dumps(CHANGE["change"])))], "resource_drift": [CHANGE]}
    rows = [
        ("p1", "w", json.dumps(plan), at),
        ("p1", "w", json.dumps(plan, indent=2), at + dt.timedelta(days=1)),
        ("p2", "w", json.dumps([{"deep": {"plan": json.dumps(text_parts)}}]), at),
        ("p3", "w", "{not json", at),
        ("p4", "w", None, at),
        ("p5", "w", "", at),
        ("p6", "w", json.dumps({"resource_changes": []}), at),
    ]
    full = [("action", 1, "delete"), ("action", 2, "create"), ("after_unknown_arn", 1, "true"), ("before_arn", 1, "arn:x")]
    want = [("p1", 1, *x) for x in full] + [("p1", 3, "action", 1, "no-op"), ("p1", 3, "after_unknown_arn", 1, "false")] + [("p2", 1, *x) for x in full]
    assert found(spark, tmp_path, rows) == sorted(want)


def test_change_as_a_shared_element(spark, tmp_path):
    import datetime as dt

    odd = {"change": {"actions": ["update"], "before": {"arn": "arn:y", "change": {"actions": ["x"]}}}}
    got = found(spark, tmp_path, [("p", "w", json.dumps({"resource_changes": [odd]}), dt.datetime(2024, 1, 1))])
    assert ("p", 1, "action", 1, "update") in got and ("p", 1, "before_arn", 1, "arn:y") in got


def test_actions_as_a_plain_value(spark, tmp_path):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    changes = [{"change": {"actions": "create"}}, {"change": {"actions": " "}}, {"change": {"actions": None}}, {"change": json.dumps({"actions": "read"})}]
    array = {"change": {"actions": ["delete", "create"]}}
    want = [("p", 1, "action", 1, "create"), ("p", 4, "action", 1, "read")]
    both = [*want, ("p", 5, "action", 1, "delete"), ("p", 5, "action", 2, "create")]
    # no array at all, beside an array, and with a table of its own for change
    assert found(spark, tmp_path, [("p", "w", json.dumps({"resource_changes": changes}), at)]) == want
    assert found(spark, tmp_path, [("p", "w", json.dumps({"resource_changes": [*changes, array]}), at)]) == both
    shared = {"change": {"before": {"change": {"actions": "no"}}}}
    assert found(spark, tmp_path, [("p", "w", json.dumps({"resource_changes": [*changes, array, shared]}), at)]) == both


def test_empty_table(spark, tmp_path):
    assert found(spark, tmp_path, []) == []


def test_links_restore_the_tree(spark):
    doc = {"m": [{"n": 1, "kids": [{"v": "a", "kids": [{"v": "b"}]}, {"v": "c"}]}, {"n": 2}]}
    got = shred(spark.createDataFrame([(1, json.dumps(doc))], "id long, payload string"), "payload", "m", [F.col("id")])
    assert "kids" in got.elements
    rows = {r.node: r for r in got.nodes.collect()}
    b = next(r for r in rows.values() if r.attrs.get("v") == "b")
    a = rows[b.parent_node]
    assert a.attrs["v"] == "a" and rows[a.parent_node].attrs["n"] == "1" and b.pos == 1

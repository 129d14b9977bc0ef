import json

import pytest
from pyspark.sql import functions as F

from tracewright.operators import plan as P
from tracewright.operators import risk as R
from tracewright.operators.graph import dot_edges

NOW = 1_767_225_600_000_000


def change(address, actions, before=None, after=None, **more):
    return {"address": address, "type": address.split(".")[-2], "name": address.split(".")[-1], "change": {"actions": actions, "before": before, "after": after, **more}}


def nodes_of(spark, **plans):
    df = spark.createDataFrame([(k, json.dumps({"resource_changes": v})) for k, v in plans.items()], "plan string, payload string")
    return P.nodes(P.resources(df, "plan", "payload")).cache()


def scores(nodes, reached=None, history=None):
    return {r["plan"]: (float(r["score"]), r["severity"]) for r in R.scored(R.facts(nodes, "plan", reached, history)).collect()}


def test_scores_that_are_known(spark):
    new = lambda n, t: [change(f"{t}.x{i}", ["create"]) for i in range(n)]
    nodes = nodes_of(
        spark,
        update=[change("aws_instance.a", ["update"])],
        replace=[change("aws_instance.a", ["delete", "create"])],
        create=new(1, "aws_instance"),
        two=new(2, "aws_instance"),
        boundary=new(1, "aws_iam_role"),
        mixed=new(6, "aws_instance"),
        ceiling=new(20, "aws_iam_role"),
        heavy=[change(f"aws_instance.r{i}", ["delete", "create"]) for i in range(4)] + [change("aws_db_instance.d[0]", ["delete"])],
        quiet=[change("aws_instance.a", ["no-op"]), change("aws_instance.b", ["read"])],
        sg=[change("aws_security_group.a", ["update"])],
    )
    assert scores(nodes) == {
        "update": (5.0, "low"), "replace": (25.0, "medium"), "create": (2.4, "low"), "two": (4.8, "low"), "boundary": (6.0, "low"), "mixed": (14.4, "low"), "ceiling": (45.0, "medium"), "heavy": (100.0, "critical"), "sg": (7.5, "low"),
    }
    history = spark.createDataFrame([("mixed", 2), ("update", 1), ("heavy", 9)], "plan string, history int")
    got = scores(nodes, None, history)
    assert got["mixed"] == (24.4, "low") and got["update"] == (10.0, "low") and got["heavy"] == (100.0, "critical")
    reached = spark.createDataFrame([("update", f"n{i}", 1) for i in range(5)] + [("sg", f"n{i}", 1) for i in range(3)], "plan string, node string, depth int")
    got = scores(nodes, reached, spark.createDataFrame([("sg", 3)], "plan string, history int"))
    assert got["update"] == (7.5, "low") and got["sg"] == (27.0, "medium")


@pytest.mark.parametrize(("score", "name"), [(75.0, "critical"), (74.9, "high"), (50.0, "high"), (25.0, "medium"), (24.9, "low"), (0.0, "low")])
def test_severities(spark, score, name):
    row = spark.range(1).select(R.severity(F.lit(score)).alias("s"), R.at_least(R.severity(F.lit(score)), "high").alias("b")).first()
    assert row.s == name and row.b == (score >= 50)


def policy(*who):
    return json.dumps({"Statement": [{"Effect": "Allow", "Principal": w} for w in who]})


def test_widened_trust(spark):
    ec2, fn, other = "ec2.amazonaws.com", "lambda.amazonaws.com", "arn:aws:iam::123456789012:root"
    role = lambda b, a: [change("aws_iam_role.r", ["update"], {"assume_role_policy": b}, {"assume_role_policy": a})]
    nodes = nodes_of(
        spark,
        service=role(policy({"Service": ec2}), policy({"Service": [ec2, fn]})),
        account=role(policy({"Service": ec2}), policy({"Service": ec2}, {"AWS": other})),
        capped=role(policy(), policy({"AWS": [other, "arn:aws:iam::1:root"]}, {"Service": fn})),
        star=role(policy({"Service": ec2}), policy("*")),
        same=role(policy({"Service": ec2}), policy({"Service": ec2})),
        text=[change("aws_iam_policy.p", ["update"], {"policy": "a"}, {"policy": "b"})],
        bad=role("{not json", "{nor this"),
        none=[change("aws_iam_role.r", ["update"], None, None)],
        plain=[change("aws_instance.i", ["update"], {"policy": "a"}, {"policy": "b"})],
    )
    got = {r["plan"]: (r["sensitivity_delta"], r["sensitivity_reason"], r["wildcard_trust"]) for r in nodes.collect()}
    assert got == {
        "service": (18, fn, False), "account": (28, other, False), "capped": (33, "arn:aws:iam::123456789012:root, arn:aws:iam::1:root, " + fn, False), "star": (8, "wildcard principal", True), "same": (0, "", False),
        "text": (8, "policy field changed", False), "bad": (8, "policy field changed", False), "none": (0, "", False), "plain": (0, "", False),
    }
    assert scores(nodes)["star"] == (50.0, "high")


GRAPH = ['digraph {', '"[root] aws_iam_instance_profile.app (expand)" -> "[root] aws_iam_role.app (expand)"', '  "aws_instance.app" -> "aws_iam_instance_profile.app";', "aws_eip.ip -> aws_instance.app", '"[root] aws_iam_role.app (expand)" -> "[root] provider[\\"registry/aws\\"]"', '"[root] aws_sqs_queue.q" -> "[root] provider[\\"registry/aws\\"]"', "}"]


def test_what_a_change_reaches(spark):
    lines = spark.createDataFrame([(x,) for x in GRAPH], "value string")
    edges = lines.select(F.lit("p").alias("plan"), dot_edges(F.col("value")).alias("e")).where("e is not null").select("plan", "e.*")
    assert edges.count() == 5
    nodes = nodes_of(spark, p=[change("aws_iam_role.app", ["update"])])
    got = {(r.node, r.depth, ">".join(r.path)) for r in R.affected(nodes, edges, "plan").collect()}
    path = ["aws_iam_role.app", "aws_iam_instance_profile.app", "aws_instance.app", "aws_eip.ip"]
    assert got == {(path[i], i, ">".join(path[: i + 1])) for i in (1, 2, 3)}
    # The provider is a seed only where that is wanted, and then reaches everything.
    assert "aws_sqs_queue.q" in {r.node for r in R.affected(nodes, edges, "plan", providers=True).collect()}
    # No control point and nothing destroyed: only the first level; what the plan changes itself is left out.
    plain = nodes_of(spark, p=[change("aws_instance.app[0]", ["update"]), change("aws_iam_instance_profile.app", ["update"])])
    assert {(r.node, r.depth) for r in R.affected(plain, edges, "plan").collect()} == set()
    why = R.why_paths(R.affected(nodes, edges, "plan"), "plan", 2).collect()
    assert [(r.place, r.target) for r in sorted(why, key=lambda r: r.place)] == [(1, path[1]), (2, path[2])]


def test_resources_of_odd_plans(spark):
    nested = {"planned_values": {"root_module": {"resources": [{"address": "a.b", "type": "a", "values": {"k": 1}}], "child_modules": [{"address": "module.m", "resources": [{"address": "module.m.c.d", "type": "c"}], "child_modules": [{"address": "module.m.module.n", "resources": [{"address": "e", "type": "e"}, {"address": "e2"}]}]}]}}}
    both = {**nested, "resource_changes": [change("a.b", ["update"], {"x": [1, {"b": 1, "a": 2}], "id": 1}, {"x": [1, {"a": 2, "b": 1}], "id": 2, "y": None}), {"type": "t", "address": "t.t", "provider_name": "registry/aws", "change": {"actions": "create"}}]}
    rows = [("n", json.dumps(nested)), ("b", json.dumps(both)), ("w", json.dumps({"plan": json.dumps(both)})), ("e", "{}"), ("x", "{broken"), ("z", None), ("s", json.dumps({"resource_changes": [{"address": "no.type"}, 3, None, {"type": "q", "change": None}]}))]
    got = {}
    for r in P.resources(spark.createDataFrame(rows, "plan string, payload string"), "plan", "payload").collect():
        got.setdefault(r["plan"], []).append((r.address, r.action, r.module, r.cloud_provider))
    assert sorted(got["n"]) == [("a.b", "unknown", None, "unknown"), ("e", "unknown", "module.m.module.n", "unknown"), ("module.m.c.d", "unknown", "module.m", "unknown")]
    assert len(got["b"]) == 4 and ("a.b", "update", None, "unknown") in got["b"] and ("t.t", "create", None, "aws") in got["b"] and got["b"] and sorted(got["w"]) == sorted(got["b"])
    assert got["s"] == [("", "no-op", None, "unknown")] and set(got) == {"n", "b", "w", "s"}
    n = P.nodes(P.resources(spark.createDataFrame(rows[1:2], "plan string, payload string"), "plan", "payload")).where("address = 'a.b'").first()
    assert n.changed_attrs == []


def test_secrets_are_redacted_at_any_depth(spark):
    after = {"name": "x", "db_Password": "p", "in": {"token": 1, "deep": {"ok": 2, "marked": 3}}, "list": [1]}
    rows = [("p", json.dumps({"resource_changes": [change("a.b", ["update"], None, after, after_sensitive={"in": {"deep": {"marked": True}}, "list": True})]}))]
    df = P.resources(spark.createDataFrame(rows, "plan string, payload string"), "plan", "payload")
    got = json.loads(df.select(P.redacted(F.col("after"), F.col("sensitive")).alias("a")).first().a)
    assert got == {"name": "x", "db_Password": "[REDACTED]", "in": {"token": "[REDACTED]", "deep": {"ok": 2, "marked": "[REDACTED]"}}, "list": "[REDACTED]"}


FIXES = "seq long, id string, issue string, resolution string, error_excerpt string, tags string, created_at string"


def test_fixes_that_matter(spark):
    rows = [
        (1, "f1", "aws_instance failed", "Resized it after the quota was raised", "Code: VcpuLimit", "aws_instance", "2025-12-20T00:00:00"),
        (2, "f2", "trouble with module.web.aws_instance.app today", "x", None, None, "2024-01-01T00:00:00Z"),
        (3, "f3", "instance_type of aws_instance", "changed", None, "sizing", "2024-01-01T00:00:00"),
        (4, "f4", "aws_instances only", "nothing", None, "aws_instances", None),
        (5, "f5", "update went wrong", None, None, "aws_instance", "never"),
    ]
    nodes = nodes_of(spark, p=[change("module.web.aws_instance.app", ["update"], {"instance_type": "a"}, {"instance_type": "b"})])
    fixes = spark.createDataFrame(rows, FIXES)
    got = [(r.seq, r.score, r.signal, r.confidence, r.supporting) for r in R.relevant_fixes(nodes, fixes, "plan", NOW).orderBy("place").collect()]
    assert got == [(1, 180, "error_code", "high", ["recency"]), (2, 140, "address", "high", ["module_path"]), (3, 100, "attribute", "medium", ["category"]), (5, 60, "type_action", "medium", [])]
    assert R.qualifying(R.relevant_fixes(nodes, fixes, "plan", NOW), "plan").first().history == 3
    todo = R.checks(nodes, R.relevant_fixes(nodes, fixes, "plan", NOW), fixes, "plan").orderBy("step", "ord", "sub").collect()
    assert [(r.source, r.check) for r in todo] == [("attribute", "Verify instance type availability in target AZ and region"), ("history", "Prior fix: Resized it after the quota was raised")]
    assert R.relevant_fixes(nodes.limit(0), fixes, "plan", NOW).collect() == [] and R.relevant_fixes(nodes, fixes.limit(0), "plan", NOW).collect() == []


def test_leaf_pairs(spark):
    rows = [("module.web.aws_instance.app", "aws_instance.app"), ("aws_instance.app", "aws_instance.app"), ("x", "x"), ("module.a", "module.a"), ("a.module.b", "a.module.b"), ("module.m.c", "m.c")]
    df = spark.createDataFrame(rows, "a string, w string")
    assert [r.g for r in df.select(R.leaf_pair(F.col("a")).alias("g")).collect()] == [w for _, w in rows]

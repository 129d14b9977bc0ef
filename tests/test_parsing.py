import pytest

from tracewright.operators import parse
from tracewright.operators.kubernetes import parse_kubernetes
from tracewright.operators.terraform import parse_terraform

BUCKET = """╷
│ Error: creating Amazon S3 Bucket (acme-data): operation error S3: CreateBucket, https response error StatusCode: 409, api error BucketAlreadyExists: the name is taken
│
│   with aws_s3_bucket.data,
│   on main.tf line 175, in resource "aws_s3_bucket" "data":
│  175: resource "aws_s3_bucket" "data" {
╵
"""
DENIED = 'Error: creating Lambda Function (api): AccessDeniedException: not allowed\n\n  with module.app.aws_lambda_function.api[0],\n  on fn.tf line 3'
AZURE = 'Error: updating Vault (kv)\n\nCode="ConflictError" Message="The name is held by a soft deleted\n vault"\n\nStatus: 409 Conflict\n  in resource "azurerm_key_vault" "kv"'
VARIABLE = 'Error: No value for required variable\n\n  on vars.tf line 9, in variable "region":'
INIT = "Error: Inconsistent dependency lock file\n\nThe following dependency selections are wrong"


def rows(parser, spark, *texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, tags string")
    return sorted((r.asDict() for r in parser(df, "text").collect()), key=lambda r: (r["id"], r["error_no"]))


def test_terraform_blocks(spark):
    a, b, c, v, i = rows(parse_terraform, spark, BUCKET, DENIED, AZURE, VARIABLE, INIT)
    assert (a["resource_address"], a["error_code"], a["file"], a["line"], a["cloud_provider"]) == ("aws_s3_bucket.data", "BucketAlreadyExists", "main.tf", 175, "aws")
    assert a["tags"] == ["terraform", "aws", "aws_s3_bucket", "BucketAlreadyExists"] and len(a["suggestions"]) == 2 and a["terraform_action"] == "create"
    assert (b["resource_address"], b["module_path"], b["error_code"]) == ("module.app.aws_lambda_function.api", "module.app", "AccessDeniedException")
    assert (c["resource_address"], c["error_code"], c["cloud_provider"]) == ("azurerm_key_vault.kv", "ConflictError", "azure") or c["resource_type"] == "vault"
    assert (v["resource_address"], v["resource_type"], v["error_code"]) == ("variable.region", "variable", "MissingRequiredVariable")
    assert (i["resource_address"], i["error_code"], i["error_message"]) == ("terraform.init", "InconsistentLockFile", "Inconsistent dependency lock file")


def test_blocks_are_told_apart_and_repeats_dropped(spark):
    got = rows(parse_terraform, spark, DENIED + "\n" + DENIED + "\n" + AZURE, None, "", "Error:", "no trouble", "x" * 300_000 + "\nError: late")
    assert [(r["id"], r["error_no"]) for r in got] == [(0, 1), (0, 2), (5, 1)]
    assert got[-1]["error_message"] == "late" and got[-1]["resource_address"] == "unknown"


SERVER = 'Error from server (Forbidden): pods "web-1" is forbidden: exceeded quota in namespace "prod"\nError from server (NotFound): deployments.apps "api" not found\n'
HELM = 'Error: UPGRADE FAILED: release "shop" failed: timed out waiting for the condition\n\nhelm upgrade shop ./chart -n store'
PODS = "NAME   READY  STATUS  RESTARTS\nweb-7f9 0/1 CrashLoopBackOff 7\ndb-0 0/1 OOMKilled 2\nNamespace: prod\nExit Code: 137\n"


def test_kubernetes_forms(spark):
    got = rows(parse_kubernetes, spark, SERVER, HELM, PODS, 'error when creating "app.yaml": admission denied: object is invalid: no', "ERROR: odd thing in jobs/nightly -n batch")
    of = lambda i: [r for r in got if r["id"] == i]
    assert [(r["error_code"], r["resource_type"], r["resource_name"], r["namespace"]) for r in of(0)] == [("Forbidden", "pods", "web-1", "prod"), ("NotFound", None, None, None)] or of(0)[1]["error_code"] == "NotFound"
    assert of(0)[0]["suggestions"][0].startswith("Request increased quotas")
    (h,) = of(1)
    assert (h["error_code"], h["helm_release"], h["namespace"], h["k8s_error_type"]) == ("Timeout", "shop", "store", "helm_upgrade")
    assert {(r["error_code"], r["pod_name"], r["exit_code"], r["severity"]) for r in of(2)} == {("CrashLoopBackOff", "web-7f9", 137, "critical"), ("OOMKilled", "db-0", 137, "critical")}
    assert (of(3)[0]["file"], of(3)[0]["k8s_error_type"]) == ("app.yaml", "kubectl_apply")
    assert (of(4)[0]["resource_type"], of(4)[0]["resource_name"], of(4)[0]["namespace"]) == ("jobs", "nightly", "batch")
    assert rows(parse_kubernetes, spark, None, "", "all is well") == []


def test_routing_and_what_is_made_of_errors(spark):
    df = spark.createDataFrame([(1, BUCKET), (2, SERVER), (3, HELM), (4, "nothing"), (5, None)], "id long, text string")
    assert {r.id: r.s for r in df.select("id", parse.source(df["text"]).alias("s")).collect()} == {1: "terraform", 2: "kubernetes", 3: "helm", 4: "unknown", 5: "unknown"}
    errors = parse.parse_errors(df, "text")
    first = {r.id: r for r in parse.to_pending(parse.first_errors(errors, ["id"]), ["id"]).collect()}
    assert first[1].kind == "resource" and first[1].file == "main.tf:175" and first[1].tags.startswith("terraform,aws,aws_s3_bucket,BucketAlreadyExists")
    assert first[2].short_message.startswith("Forbidden: ") and len(first[2].short_message) <= 120 and len(first[2].error_id) == 12
    lines = {r.id: r.summary for r in parse.summary(errors, ["id"]).collect()}
    assert lines[2] == "2 errors found: 2 kubernetes error(s)" and lines[1].startswith("1 terraform error: BucketAlreadyExists: ")


@pytest.mark.parametrize(("text", "want"), [("a | b | c", ("a", "b | c")), ("alone", ("alone", None)), ("|x", ("", "x"))])
def test_quick_capture(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(parse.quick_capture(parse.F.col("t")).alias("q")).first().q
    assert (row.issue, row.resolution) == want

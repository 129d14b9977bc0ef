import json

from pyspark.sql import functions as F

from tracewright.operators import imports as I
from tracewright.operators import pending, sync
from tracewright.operators.similar import error_codes, similar_fixes
from tracewright.sources import files


def one(spark, columns, **values):
    df = spark.createDataFrame([({k: v for k, v in values.items()},)], "f map<string,string>")
    return I.drafts(df, F.lit(1), F.lit("jira"), columns(F.col("f"))).first()


def test_jira_rows_and_records(spark):
    r = one(spark, I.jira_rows, summary="<p>aws_s3_bucket  denied</p>", comment="first\n-----\nUse another <b>role</b>\n\n------\n ", labels="On Call;x y", components="", key="A-1", description="head\n\ntail", status="Done")
    assert (r.issue, r.resolution, r.error_excerpt, r.bad) == ("aws_s3_bucket denied", "Use another <b>role</b>", "head", False) or r.resolution == "Use another role"
    assert r.tags == "aws_s3_bucket,kw:role,source:jira:a-1,on_call,x_y" and r.notes == "Source: jira A-1"
    assert one(spark, I.jira_rows, summary="only").bad and one(spark, I.jira_rows, comment="only").bad
    record = {"key": "B-2", "fields": {"summary": "s", "comment": {"comments": [{"body": "no"}, {"body": "yes"}]}, "labels": ["L 1"], "components": [{"name": "C"}], "status": {"name": "Closed"}}}
    df = spark.createDataFrame([(json.dumps(record),), ("{}",)], "j string").select(F.parse_json("j").alias("v"))
    got = I.drafts(df, F.monotonically_increasing_id(), F.lit("jira"), I.jira_records(F.col("v"))).orderBy("pos").collect()
    assert (got[0].resolution, got[0].tags, got[0].status) == ("yes", "source:jira:b-2,l_1,c", "Closed") and got[1].bad


def test_servicenow_rows(spark):
    r = one(spark, I.servicenow_rows, short_description="s", resolution_notes="r", work_notes="w", state="7", number="INC1", category="net", **{"close code": "ok"})
    assert (r.resolution, r.status, r.notes) == ("r", "7", "Source: jira INC1 | close code: ok | category: net")
    assert one(spark, I.servicenow_rows, short_description="s", description="d").bad


def test_notion_pages(spark):
    text = lambda s: [{"plain_text": s}]
    page = {"id": "ab-cd", "url": "https://x", "properties": {"Incident title": {"type": "title", "title": text("T1")}, "Ticket Status": {"type": "status", "status": {"name": "Fixed"}}, "Fix / Mitigation": {"type": "rich_text", "rich_text": []}}}
    block = lambda kind, s: json.dumps({"type": kind, kind: {"rich_text": text(s)}})
    blocks = [block("heading_1", "Intro"), block("paragraph", "no"), block("heading_2", "Root Cause"), block("paragraph", "yes"), block("divider", "x"), block("to_do", "and this"), block("heading_2", "Later"), block("paragraph", "no")]
    df = spark.createDataFrame([(1, json.dumps(page), blocks), (2, json.dumps(page), blocks[:2]), (3, json.dumps(page), None), (4, "{}", blocks)], "n long, p string, b array<string>")
    got = {r.pos: r for r in I.drafts(df, F.col("n"), F.lit("notion"), I.notion_pages(F.col("p"), F.col("b"))).collect()}
    assert (got[1].issue, got[1].resolution, got[1].status, got[1].tags) == ("T1", "yes\nand this", "Fixed", "source:notion:abcd")
    assert got[2].resolution == "Intro\nno" and got[3].bad and got[4].bad and got[1].notes.endswith("url: https://x")


def test_dispositions(spark):
    rows = [(1, "a", "r aws_vpc", "Done", "K1"), (2, "a", "r aws_vpc", "done ", "K1"), (3, "a", "", "Done", "K2"), (4, "a", "plain", "Done", "K3"), (5, "a", "aws_vpc", "Done", "K3"), (6, "a", "aws_vpc", "Open", "K4"), (7, "a", "aws_vpc", "Done", "OLD"), (8, "a", "aws_vpc", "Done", None), (9, "b", "aws_vpc", "Done", "")]
    df = spark.createDataFrame(rows, "pos long, i string, r string, s string, k string")
    text = lambda c: F.coalesce(c, F.lit(""))
    d = I.drafts(df, F.col("pos"), F.lit("jira"), {"source_id": text(df.k), "status": df.s, "issue": df.i, "resolution": df.r, "error_excerpt": F.lit(None), "labels": F.array().cast("array<string>"), "note": F.lit("")})
    store = spark.createDataFrame([("source:jira:old",)], "tag string")
    kinds = lambda **kw: [r.disposition for r in I.disposed(d, store, **kw).orderBy("pos").collect()]
    assert kinds(closed_only=True) == ["imported", "duplicate", "bad", "low_signal", "imported", "open", "duplicate", "imported", "duplicate"]
    assert kinds(dry_run=True) == ["imported", "imported", "bad", "low_signal", "imported", "imported", "duplicate", "imported", "imported"]
    some = I.disposed(d, store).where("disposition = 'imported'")
    choices = spark.createDataFrame([(1, "s"), (5, "a"), (8, "q")], "pos long, choice string")
    assert [r.pos for r in I.reviewed(some, choices).orderBy("pos").collect()] == [5, 6]
    assert I.counters(I.disposed(d.limit(0), store), ["system"]).collect() == []


def test_source_tags(spark):
    df = spark.createDataFrame([("a, source:jira:X:1,b",), (None,), ("a",)], "t string")
    got = df.select(I.source_tag(df.t).alias("s"), I.source_id(df.t).alias("i"), I.with_source_tag(df.t, F.lit("source:n:2")).alias("w")).collect()
    assert [tuple(r) for r in got] == [("source:jira:X:1", "X:1", "a,b,source:n:2"), (None, "", "source:n:2"), (None, "", "a,source:n:2")]


FIX = dict(id="f1", issue="i", resolution="r", error_excerpt=None, tags="b, a", notes="n1", created_at="2024", updated_at="2025", author=None, author_email=None, is_private=False)


def test_sync(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(list(rows), files.FIX_SCHEMA)
    local = make(FIX, dict(FIX, id="f2", is_private=True), dict(FIX, id="f3"), dict(FIX, id="f4", tags="source:jira:A-1"))
    committed = files.to_markdown(make(FIX, dict(FIX, id="f3", notes="other")))
    ids = lambda df: sorted(r.id for r in df.collect())
    listed = spark.createDataFrame([("f4",)], "id string")
    assert ids(sync.to_push(local, committed)) == ["f3", "f4"] and ids(sync.to_push(local, committed, listed)) == ["f3"] and ids(sync.to_push(local, committed, listed, True)) == ["f1", "f3"]
    assert "**Source:** jira / A-1" in files.to_markdown(local).where("id = 'f4'").first().markdown
    assert sync.push_message(listed) == "Add fix: f4" and {r.author for r in sync.signed(local, "N", "e").collect()} == {"N"}
    got = {r.id: r for r in sync.rebuilt(local, files.to_markdown(make(dict(FIX, id="f2", issue="new"), dict(FIX, id="f9")))).collect()}
    assert set(got) == {"f1", "f2", "f3", "f4", "f9"} and got["f2"].issue == "new" and got["f2"].is_private and not got["f9"].is_private
    remote = make(dict(FIX, resolution="r2", tags="c,a", notes=None, updated_at="2026"), dict(FIX, id="f3", notes="x"))
    choices = spark.createDataFrame([("f1", "merge"), ("f3", "remote"), ("f2", "remote"), ("f4", "local")], "id string, choice string")
    out = {r.id: r for r in sync.resolved(local, remote, choices).collect()}
    assert set(out) == {"f1", "f3", "f4"} and out["f1"].tags == "a,b,c" and out["f1"].updated_at == "2026" and out["f3"].notes == "x"
    assert out["f1"].notes == "### Local Notes:\nn1\n\n### Local Resolution (merged):\nr"
    paths = spark.createDataFrame([("docs/f1.md",), ("docs/zz.md",), ("README.md",)], "path string")
    assert sorted((r.fix_id, r.known) for r in sync.conflicts(paths, local).collect()) == [("f1", True), ("zz", False)]
    files.write_markdown(local, f"{tmp_path}/docs")
    assert {r.id for r in files.read_markdown(spark, f"{tmp_path}/docs").collect()} == {"f1", "f2", "f3", "f4"}
    files.write_store(local, f"{tmp_path}/store")
    files.write_store(spark.read.parquet(f"{tmp_path}/store").where("id = 'f1'"), f"{tmp_path}/store")
    assert spark.read.parquet(f"{tmp_path}/store").count() == 1


def test_pending_lookups(spark):
    rows = [(1, "ab1", "c", "f", "s1", "pending", "E", "m"), (2, "ab2", "c", "f", "s2", "pending", "E", "m"), (3, "3x", None, "f", "s3", "resolved", None, None)]
    df = spark.createDataFrame([(*r, f"2025-01-0{r[0]}T00:00:00") for r in rows], "seq long, error_id string, cwd string, command_family string, session_id string, status string, error_code string, short_message string, deferred_at string")
    assert pending.picked(df, "2").first().error_id == "ab2" and pending.picked(df, "ab").first().seq == 1 and pending.picked(df, "3").first().error_id == "3x" and pending.picked(df, "9").count() == 0
    assert pending.without_prefix(df, "ab").count() == 1 and pending.without_prefix(df, "").count() == 3
    assert [tuple(r) for r in pending.older_sessions(df).collect()] == [("c", "f", 1, 1)]
    assert tuple(pending.elsewhere(df, "c").first()) == (2, 0)
    done, gone = pending.resolve(df, spark.createDataFrame([(1, None), (3, "q")], "first_seq long, choice string"))
    assert [r.seq for r in done.collect()] == [1] and gone.count() == 3


def test_similar_fixes(spark):
    fixes = spark.createDataFrame(
        [(1, "aws_instance.web quota", "raised the limit", "code: vcpulimit", "aws_instance,ops"), (2, "aws_instance.web quota", "raised", "code: vcpulimit", "aws_instance"), (3, "unrelated", "nothing", None, None), (4, None, None, None, None)],
        "seq long, issue string, resolution string, error_excerpt string, tags string",
    )
    errors = spark.createDataFrame([(7, "Error on aws_instance.web: code: VcpuLimit quota", "ops", None), (8, None, None, None)], "query long, text string, tags string, address string")
    got = [tuple(r) for r in similar_fixes(errors, fixes).collect()]
    # address 25, code in the excerpt 20, type 8, tag 5, shared words
    assert [r[:3] for r in got] == [(7, 1, 1)] and got[0][3] >= 58
    assert similar_fixes(errors.limit(0), fixes).collect() == [] and similar_fixes(errors, fixes.limit(0)).collect() == []
    codes = spark.createDataFrame([('status 403 <code>x1</code> api error foo.bar accessdenied error: bad',)], "t string").select(error_codes(F.col("t")).alias("c")).first().c
    assert set(codes) >= {"403", "x1", "foo.bar", "accessdenied", "bad"}

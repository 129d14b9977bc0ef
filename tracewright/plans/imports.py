"""Queries of ticket imports: mapping, tags, dispositions and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import fields as X
from tracewright.operators import imports as I
from tracewright.sources.tables import load


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    """All tickets as drafts, ordered by batch and id."""
    t = load(spark, d, "ticket_imports")
    pos = F.col("batch_no") * 10**10 + F.col("import_id")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    labels = F.filter(F.transform(F.split(F.replace(text("labels"), F.lit(";"), F.lit(",")), ","), lambda x: X.slug(F.trim(x))), lambda x: x != "")
    columns = {
        "source_id": F.trim(text("source_key")),
        "status": text("status"),
        "issue": X.without_markup(text("issue")),
        "resolution": X.without_markup(I.last_comment(text("resolution"))),
        "error_excerpt": X.without_markup(I.first_paragraph(text("error_excerpt"))),
        "labels": labels,
        "note": F.lit(""),
    }
    return I.drafts(t, pos, F.lower("source_system"), columns)


def _disposed(spark: SparkSession, d: str, **how: bool) -> DataFrame:
    store = load(spark, d, "fixes").select(I.source_tag(F.col("tags")).alias("tag")).where("tag is not null")
    return I.disposed(_drafts(spark, d), store, **how)


def import_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every ticket as a fix, with what becomes of it."""
    return _disposed(spark, d).select((F.col("pos") % 10**10).alias("import_id"), "issue", "resolution", "error_excerpt", "tags", "notes", "disposition")


def import_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counters of every batch."""
    rows = _disposed(spark, d, closed_only=True).withColumn("batch_no", F.floor(F.col("pos") / 10**10))
    return I.counters(rows, ["batch_no"])


def import_dry_run(spark: SparkSession, d: str) -> DataFrame:
    """The counters of a dry run of everything, in which repeats within the import still count as imported."""
    return I.counters(_disposed(spark, d, dry_run=True), ["system"])


def import_tags(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent tags of what is imported."""
    return I.top_tags(_disposed(spark, d))


QUERIES = {f.__name__: f for f in (import_rows, import_counts, import_dry_run, import_tags)}

_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def _clean(c: str) -> str:
    untagged = f"CASE WHEN regexp_matches({c}, '(?i)<(p|br|div|span|a)\\b|</') THEN regexp_replace({c}, '(?i)</?(p|br|div|span|b|i|em|strong|li|ul|ol|a)\\b[^>]*>', ' ', 'g') ELSE {c} END"
    tidy = _STRIP.format("regexp_replace(l, '[ \\t]+', ' ', 'g')")
    lines = f"array_to_string(list_transform(string_split({untagged}, chr(10)), lambda l: {tidy}), chr(10))"
    return _STRIP.format("regexp_replace(" + lines + ", '\\n{3,}', chr(10) || chr(10), 'g')")


_SEGMENTS = "list_filter(list_transform(string_split_regex(coalesce(resolution,''), '\\n-{5,}\\n'), lambda s: " + _STRIP.format("s") + "), lambda s: s<>'')"
_SLUG = "trim(regexp_replace(regexp_replace(lower(trim(x)), '[ -]+', '_', 'g'), '\\W', '', 'g'), '_')"
_KW = "[" + ", ".join(f"CASE WHEN regexp_matches(lower(txt), '\\b{k}\\b') THEN 'kw:{k}' END" for k in ("alb", "bucket", "ec2", "iam", "lambda", "rbac", "rds", "role", "s3", "security_group", "subnet", "terraform", "vpc")) + "]"
_ROWS = f"""t AS (SELECT import_id, batch_no, lower(source_system) AS system, trim(coalesce(source_key,'')) AS key, coalesce(status,'') AS status, {_clean("coalesce(issue,'')")} AS issue,
  {_clean("(CASE WHEN len(" + _SEGMENTS + ")>1 THEN " + _SEGMENTS + "[-1] ELSE " + _STRIP.format("coalesce(resolution,'')") + " END)")} AS resolution, {_clean("split_part(coalesce(error_excerpt,''), chr(10)||chr(10), 1)")} AS ex,
  list_filter(list_transform(string_split(replace(coalesce(labels,''),';',','), ','), lambda x: {_SLUG}), lambda x: x<>'') AS labels FROM ticket_imports),
u AS (SELECT *, concat_ws(' ', issue, resolution, ex) AS txt, 'source:' || system || ':' || coalesce(nullif(key,''),'unknown') AS tag FROM t),
v AS (SELECT *, list_concat(list_sort(list_distinct(regexp_extract_all(txt, '\\b((?:aws|azurerm|google|kubernetes)_\\w+)\\b', 1))), list_sort(list_filter({_KW}, lambda k: k IS NOT NULL)), [tag], labels) AS raw FROM u),
e AS (SELECT import_id, string_agg(x, ',' ORDER BY i) AS tags FROM (SELECT import_id, x, min(i) AS i FROM (SELECT import_id, lower(trim(unnest(raw))) AS x, generate_subscripts(raw,1) AS i FROM v) WHERE x<>'' GROUP BY 1,2) GROUP BY 1),
w AS (SELECT v.* EXCLUDE (tag), e.tags, issue='' OR resolution='' AS bad, list_filter(string_split(e.tags,','), lambda x: starts_with(x,'source:'))[1] AS tag, len(list_filter(string_split(e.tags,','), lambda x: regexp_matches(x,'^(aws_|azurerm_|google_|kubernetes_)\\w+$') OR x IN ('kw:terraform','kw:iam','kw:rbac','kw:kubernetes')))>0 AS keep,
  CASE system WHEN 'jira' THEN lower(trim(status)) IN ('done','closed','resolved') WHEN 'servicenow' THEN lower(trim(status)) IN ('closed','resolved','7','6') ELSE lower(trim(status)) IN ('done','closed','resolved','fixed','complete','completed','solved') END AS shut FROM v JOIN e USING (import_id)),
known AS (SELECT DISTINCT list_filter(list_transform(string_split(tags,','), lambda x: trim(x)), lambda x: starts_with(x,'source:'))[1] AS tag FROM fixes)"""


def _judge(inside: str, late: str = "false OR (f.tag IS NOT NULL AND row(batch_no, import_id) > f.first)") -> str:
    return f"f AS (SELECT tag, min(row(batch_no, import_id)) AS first FROM w WHERE NOT bad AND keep AND ({inside}) GROUP BY 1), j AS (SELECT w.*, CASE WHEN bad THEN 'bad' WHEN NOT ({inside}) THEN 'open' WHEN w.tag IN (SELECT tag FROM known WHERE tag IS NOT NULL) OR ({late}) THEN 'duplicate' WHEN NOT keep THEN 'low_signal' ELSE 'imported' END AS disposition FROM w LEFT JOIN f ON f.tag=w.tag)"


_COUNT = ", ".join(f"count(*) FILTER (disposition='{d}') AS {n}" for d, n in (("imported", "imported"), ("open", "skipped"), ("duplicate", "duplicates"), ("low_signal", "low_signal"), ("bad", "bad_rows")))
SQL = {
    "import_rows": f"WITH {_ROWS}, {_judge('true')} SELECT import_id, substr(issue,1,300) AS issue, substr(resolution,1,3000) AS resolution, nullif(substr(ex,1,2000),'') AS error_excerpt, tags, 'Source: ' || system || CASE WHEN key<>'' THEN ' ' || key ELSE '' END AS notes, disposition FROM j",
    "import_counts": f"WITH {_ROWS}, {_judge('shut')} SELECT batch_no, {_COUNT} FROM j GROUP BY 1",
    "import_dry_run": f"WITH {_ROWS}, {_judge('true', 'false')} SELECT system, {_COUNT} FROM j GROUP BY 1",
    "import_tags": f"WITH {_ROWS}, {_judge('true')}, x AS (SELECT batch_no, import_id, unnest(string_split(tags,',')) AS tag, generate_subscripts(string_split(tags,','),1) AS i FROM j WHERE disposition='imported') SELECT tag, count(*) AS n FROM x GROUP BY tag ORDER BY n DESC, min(row(batch_no,import_id,i)) LIMIT 10",
}

"""Queries of deferred errors, imports, parsing and synchronisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import fields as X
from tracewright.operators import pending, sync
from tracewright.operators.current import current_rows
from tracewright.sources.files import to_markdown
from tracewright.sources.tables import load

NOW_US = 1_767_225_600_000_000  # 2026-01-01, the injected "now"
_US = "epoch_us(TRY_CAST(CASE WHEN regexp_matches({c},'(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') THEN {c} ELSE {c}||'Z' END AS TIMESTAMPTZ))"
_AT = _US.format(c="trim(deferred_at)")


def _errors(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pending_errors")


def pending_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last stored row of each error."""
    return pending.latest(_errors(spark, d)).select("seq", "error_id", "status")


def pending_open(spark: SparkSession, d: str) -> DataFrame:
    """The errors that are still pending in their last row."""
    return pending.latest(_errors(spark, d)).where("status = 'pending'").select("seq", "error_id")


def pending_status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Latest rows by status."""
    return pending.latest(_errors(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def pending_context(spark: SparkSession, d: str) -> DataFrame:
    """Errors of the folder with most of them, deferred in the year before "now", by command family."""
    rows = _errors(spark, d)
    top = rows.groupBy("cwd").agg(F.count(F.lit(1)).alias("n")).where("cwd is not null").orderBy(F.desc("n"), "cwd").limit(1)
    at = pending.instant_us(rows["deferred_at"])
    recent = rows.where((at >= NOW_US - 365 * 24 * 3_600_000_000) & (at < NOW_US))
    return recent.join(F.broadcast(top.select("cwd")), "cwd").groupBy("command_family").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session_id").alias("sessions"))


def pending_latest_session(spark: SparkSession, d: str) -> DataFrame:
    """The most recent session of each folder and command family."""
    return pending.latest_sessions(_errors(spark, d))


def pending_supersede(spark: SparkSession, d: str) -> DataFrame:
    """Errors by status before and after older sessions are superseded."""
    return pending.supersede(_errors(spark, d)).groupBy(F.col("was").alias("status"), F.col("status").alias("after")).agg(F.count(F.lit(1)).alias("n"))


def pending_older(spark: SparkSession, d: str) -> DataFrame:
    """What is still pending from sessions before each context's latest."""
    return pending.older_sessions(_errors(spark, d))


def pending_resolved(spark: SparkSession, d: str) -> DataFrame:
    """The errors documented when every third bundle is skipped."""
    rows = _errors(spark, d).where("status = 'pending'")
    choices = pending.bundles(rows).select("first_seq", F.when(F.col("first_seq") % 3 == 0, "s").alias("choice"))
    return pending.resolve(rows, choices)[0].select("seq", "error_id")


def pending_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Errors by what their address is about."""
    return _errors(spark, d).groupBy(X.kind_of(F.col("resource_address")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def pending_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Identical errors together."""
    return pending.bundles(_errors(spark, d))


def pending_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions and errors of each folder."""
    return _errors(spark, d).groupBy("cwd").agg(F.countDistinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("n"))


def command_families(spark: SparkSession, d: str) -> DataFrame:
    """How often each command family occurs."""
    return _errors(spark, d).groupBy(X.command_family(F.col("command")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


def error_ids(spark: SparkSession, d: str) -> DataFrame:
    """The stable id of each error."""
    return _errors(spark, d).select("seq", X.error_id(*[F.col(c) for c in ("resource_address", "error_code", "file", "short_message")]).alias("stable_id"))


def address_parts(spark: SparkSession, d: str) -> DataFrame:
    """Base, module path, leaf and provider of each address."""
    a = F.col("resource_address")
    leaf = X.leaf_address(a)
    return _errors(spark, d).select("seq", X.base_address(a).alias("base"), X.module_path(a).alias("module"), leaf.alias("leaf"), X.provider(leaf).alias("provider"))


def file_lines(spark: SparkSession, d: str) -> DataFrame:
    """Errors by file, with the lines they name."""
    f = F.split("file", ":")
    return _errors(spark, d).where("file is not null").groupBy(f[0].alias("path")).agg(F.count(F.lit(1)).alias("n"), F.min(F.expr("try_cast(split(file, ':')[1] as int)")).alias("first_line"), F.max(F.expr("try_cast(split(file, ':')[1] as int)")).alias("last_line"))


def error_summary(spark: SparkSession, d: str) -> DataFrame:
    """Errors by type and provider, with subtotals."""
    rows = _errors(spark, d).select("error_type", X.provider(X.leaf_address(F.col("resource_address"))).alias("provider"))
    return rows.cube("error_type", "provider").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def import_clean(spark: SparkSession, d: str) -> DataFrame:
    """Tickets' resolutions without markup."""
    return load(spark, d, "ticket_imports").select("import_id", X.without_markup(F.col("resolution")).alias("text"))


def import_detect(spark: SparkSession, d: str) -> DataFrame:
    """Resource types and keywords that tickets name."""
    text = F.concat_ws(" ", "issue", "resolution", "error_excerpt")
    return load(spark, d, "ticket_imports").select("import_id", F.array_join(X.resource_types(text), ",").alias("types"), F.array_join(X.keyword_tags(text), ",").alias("keywords"))


def import_slug(spark: SparkSession, d: str) -> DataFrame:
    """Tags made of status spellings."""
    return load(spark, d, "ticket_imports").groupBy(X.slug(F.col("status")).alias("slug")).agg(F.count(F.lit(1)).alias("n"))


def import_disposition(spark: SparkSession, d: str) -> DataFrame:
    """Tickets per batch: bad, seen before by source key, or new. Of a key the first row is new."""
    rows = load(spark, d, "ticket_imports").select("import_id", "batch_no", F.lower(F.trim("source_key")).alias("k"), F.lower("source_system").alias("s"), (X.filled(F.col("issue")) & X.filled(F.col("resolution"))).alias("good"))
    first = rows.where("good and k is not null").groupBy("s", "k").agg(F.min(F.struct("batch_no", "import_id")).alias("first"))
    judged = rows.join(first, ["s", "k"], "left")
    kind = F.when(~F.col("good"), "bad").when(F.col("k").isNotNull() & (F.struct("batch_no", "import_id") > F.col("first")), "duplicate").otherwise("new")
    return judged.groupBy("batch_no", kind.alias("disposition")).agg(F.count(F.lit(1)).alias("n"))


def tag_merge(spark: SparkSession, d: str) -> DataFrame:
    """Tags, error type and code of each error in one list; of spellings that differ in case the first stays."""
    values = F.concat(F.split(F.coalesce("tags", F.lit("")), ","), F.array("error_type", "error_code"))
    return _errors(spark, d).select("seq", F.array_join(X.distinct_ignoring_case(F.transform(values, lambda t: F.trim(t))), ",").alias("tags"))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cols = ["issue", "resolution", "error_excerpt", "tags", "notes", "created_at", "updated_at", "author", "author_email", "is_private"]
    return tuple(current_rows(load(spark, d, t), cols) for t in ("fixes", "fixes_remote"))


def sync_push(spark: SparkSession, d: str) -> DataFrame:
    """Public fixes whose document the remote copy lacks or has otherwise."""
    local, remote = (x.withColumnRenamed("fix_key", "id") for x in _sides(spark, d))
    return sync.to_push(local, to_markdown(remote)).select(F.col("id").alias("fix_key"))


def sync_resolve(spark: SparkSession, d: str) -> DataFrame:
    """The fixes that both copies have, merged."""
    local, remote = (x.withColumnRenamed("fix_key", "id") for x in _sides(spark, d))
    return sync.resolved(local, remote, local.select("id", F.lit("merge").alias("choice")))


def sync_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """The local copy after a pull of the remote documents: ids, and whether they are private."""
    local, remote = (x.withColumnRenamed("fix_key", "id") for x in _sides(spark, d))
    return sync.rebuilt(local, to_markdown(remote)).select("id", F.coalesce("is_private", F.lit(False)).alias("is_private"))


def sync_merge_tags(spark: SparkSession, d: str) -> DataFrame:
    """The union of both copies' tags, sorted."""
    local, remote = _sides(spark, d)
    both = local.select("fix_key", X.comma_tags(F.col("tags")).alias("a")).join(remote.select("fix_key", X.comma_tags(F.col("tags")).alias("b")), "fix_key")
    return both.select("fix_key", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("tags"))


def sync_status(spark: SparkSession, d: str) -> DataFrame:
    """How many fixes are on one side only, on both, or private."""
    local, remote = _sides(spark, d)
    r = remote.select("fix_key", F.lit(1).alias("r"))
    full = local.select("fix_key", "is_private", F.lit(1).alias("l")).join(r, "fix_key", "full")
    count = lambda c: F.count(F.when(c, 1))
    return full.agg(count(F.col("r").isNull()).alias("ahead"), count(F.col("l").isNull()).alias("behind"), count(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("common"), count(F.col("is_private")).alias("private"), count(F.col("l").isNotNull() & ~F.coalesce("is_private", F.lit(False))).alias("pushable")).withColumn("state", sync.relation(F.col("ahead"), F.col("behind")))


def conflict_log(spark: SparkSession, d: str) -> DataFrame:
    """The sync log by conflict type: entries, fixes, last detection."""
    log = load(spark, d, "sync_conflicts")
    return log.groupBy("conflict_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.lower(F.trim("fix_id"))).alias("fixes"), F.max("detected_at").cast("timestamp_ntz").alias("last"))


QUERIES = {
    f.__name__: f
    for f in (pending_latest, pending_open, pending_status_counts, pending_context, pending_latest_session, pending_supersede, pending_older, pending_resolved, pending_kinds, pending_bundles, pending_sessions, command_families, error_ids, address_parts, file_lines, error_summary, import_clean, import_detect, import_slug, import_disposition, tag_merge, sync_push, sync_resolve, sync_rebuilt, sync_merge_tags, sync_status, conflict_log)
}

_LATEST = "(SELECT * FROM pending_errors QUALIFY row_number() OVER (PARTITION BY error_id ORDER BY seq DESC)=1)"
_LEAF = "regexp_replace(split_part(resource_address,'[',1), '^(module\\.[^.]+\\.)+', '')"
_PROVIDER = "CASE WHEN starts_with({x},'aws_') THEN 'aws' WHEN starts_with({x},'azurerm_') OR starts_with({x},'azuread_') THEN 'azure' WHEN starts_with({x},'google_') THEN 'gcp' WHEN starts_with({x},'kubernetes_') OR starts_with({x},'helm_') THEN 'kubernetes' ELSE 'unknown' END"
_LINE = "lower(regexp_replace(regexp_replace(regexp_replace(short_message,'(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}','<UUID>','g'),'(?i)RequestID:\\s*\\S+','RequestID:<UUID>','g'),'^\\s+|\\s+$','','g'))"
_COMMA = "list_distinct(list_filter(list_transform(string_split(coalesce({t},''),','), lambda t: lower(trim(t))), lambda t: t<>''))"


def _cur(table: str) -> str:
    at = _US.format(c="trim(updated_at)")
    return f"(SELECT lower(trim(id)) AS fix_key, * FROM {table} QUALIFY row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY coalesce({at}, -9223372036854775807) DESC, seq DESC)=1)"


_TEXT = "concat_ws(' ', issue, resolution, error_excerpt)"
_SESSIONS = f"SELECT cwd, command_family, arg_max(session_id, row({_AT}, seq)) AS session_id FROM pending_errors WHERE {_AT} IS NOT NULL AND session_id IS NOT NULL GROUP BY 1,2"
SQL = {
    "pending_latest": f"SELECT seq, error_id, status FROM {_LATEST}",
    "pending_open": f"SELECT seq, error_id FROM {_LATEST} WHERE status='pending'",
    "pending_status_counts": f"SELECT status, count(*) AS n FROM {_LATEST} GROUP BY 1",
    "pending_context": f"WITH t AS (SELECT cwd FROM pending_errors WHERE cwd IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, cwd LIMIT 1) SELECT command_family, count(*) AS n, count(DISTINCT session_id) AS sessions FROM pending_errors WHERE cwd=(SELECT cwd FROM t) AND {_AT} >= {NOW_US}-365*24*3600000000 AND {_AT} < {NOW_US} GROUP BY 1",
    "pending_latest_session": _SESSIONS,
    "pending_supersede": f"WITH s AS ({_SESSIONS}) SELECT p.status, CASE WHEN p.status='pending' AND p.session_id IS NOT NULL AND p.session_id<>s.session_id THEN 'superseded' ELSE p.status END AS after, count(*) AS n FROM pending_errors p LEFT JOIN s ON p.cwd IS NOT DISTINCT FROM s.cwd AND p.command_family IS NOT DISTINCT FROM s.command_family GROUP BY 1,2",
    "pending_bundles": f"SELECT error_code, coalesce({_LINE},'') AS line, count(*) AS n, min(seq) AS first_seq FROM pending_errors GROUP BY error_code, coalesce({_LINE},''), CASE WHEN coalesce(error_code,'')='' THEN seq END",
    "pending_sessions": "SELECT cwd, count(DISTINCT session_id) AS sessions, count(*) AS n FROM pending_errors GROUP BY 1",
    "command_families": "SELECT array_to_string(list_slice(list_filter(string_split_regex(trim(coalesce(command,'')),'\\s+'), lambda w: w<>'' AND NOT starts_with(w,'-')),1,2),' ') AS family, count(*) AS n FROM pending_errors GROUP BY 1",
    "error_ids": "SELECT seq, substr(sha256(coalesce(resource_address,'')||chr(10)||coalesce(error_code,'')||chr(10)||coalesce(file,'')||chr(10)||regexp_replace(lower(substr(coalesce(short_message,''),1,160)),'^\\s+|\\s+$','','g')),1,12) AS stable_id FROM pending_errors",
    "address_parts": f"SELECT seq, split_part(resource_address,'[',1) AS base, regexp_replace(regexp_extract(resource_address,'^((?:module\\.[^.]+\\.)*)',1),'\\.$','') AS module, {_LEAF} AS leaf, {_PROVIDER.format(x=_LEAF)} AS provider FROM pending_errors",
    "file_lines": "SELECT split_part(file,':',1) AS path, count(*) AS n, min(TRY_CAST(split_part(file,':',2) AS INT)) AS first_line, max(TRY_CAST(split_part(file,':',2) AS INT)) AS last_line FROM pending_errors WHERE file IS NOT NULL GROUP BY 1",
    "error_summary": f"WITH r AS (SELECT error_type, {_PROVIDER.format(x=_LEAF)} AS provider FROM pending_errors) SELECT error_type, provider, count(*) AS n, CAST(grouping(error_type, provider) AS INT) AS level FROM r GROUP BY CUBE (error_type, provider)",
    "import_clean": "SELECT import_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(CASE WHEN regexp_matches(resolution,'(?i)<(?:p|br|div|span|a)\\b|</') THEN regexp_replace(resolution,'(?i)</?(?:%s)\\b[^>]*>',' ','g') ELSE resolution END, chr(10)), lambda l: regexp_replace(regexp_replace(l,'[ \\t]+',' ','g'),'^\\s+|\\s+$','','g')), chr(10)),'\\n{3,}',chr(10)||chr(10),'g'),'^\\s+|\\s+$','','g') AS text FROM ticket_imports" % "|".join(X.FORMATTING_TAGS),
    "import_detect": f"WITH t AS (SELECT import_id, lower({_TEXT}) AS t FROM ticket_imports), m AS (SELECT import_id, m, min(i) AS i FROM (SELECT import_id, unnest(regexp_extract_all(t,'{X.TYPE_PATTERN}')) AS m, generate_subscripts(regexp_extract_all(t,'{X.TYPE_PATTERN}'),1) AS i FROM t) GROUP BY 1,2) SELECT t.import_id, coalesce((SELECT string_agg(m, ',' ORDER BY i) FROM m WHERE m.import_id=t.import_id),'') AS types, array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(t,'\\b{k}\\b') THEN 'kw:{k}' END" for k in X.KEYWORDS)}], lambda k: k IS NOT NULL), ',') AS keywords FROM t",
    "import_slug": "SELECT trim(regexp_replace(regexp_replace(lower(status),'[ -]+','_','g'),'\\W','','g'),'_') AS slug, count(*) AS n FROM ticket_imports GROUP BY 1",
    "import_disposition": "WITH r AS (SELECT import_id, batch_no, lower(trim(source_key)) AS k, lower(source_system) AS s, regexp_matches(coalesce(issue,''),'\\S') AND regexp_matches(coalesce(resolution,''),'\\S') AS good FROM ticket_imports), w AS (SELECT *, row_number() OVER (PARTITION BY s,k,good ORDER BY batch_no, import_id) AS i FROM r) SELECT batch_no, CASE WHEN NOT good THEN 'bad' WHEN k IS NOT NULL AND i>1 THEN 'duplicate' ELSE 'new' END AS disposition, count(*) AS n FROM w GROUP BY 1,2",
    "tag_merge": "WITH v AS (SELECT seq, list_concat(list_transform(string_split(coalesce(tags,''),','), lambda t: trim(t)), [error_type, error_code]) AS v FROM pending_errors), u AS (SELECT seq, unnest(v) AS t, generate_subscripts(v,1) AS i FROM v), f AS (SELECT seq, arg_min(t,i) AS t, min(i) AS i FROM u WHERE t IS NOT NULL AND t<>'' GROUP BY seq, lower(t)) SELECT v.seq, coalesce((SELECT string_agg(t, ',' ORDER BY i) FROM f WHERE f.seq=v.seq),'') AS tags FROM v",
    "sync_push": f"SELECT l.fix_key FROM {_cur('fixes')} l LEFT JOIN {_cur('fixes_remote')} r USING (fix_key) WHERE NOT coalesce(l.is_private,false) AND (r.id IS NULL OR {' OR '.join(f"coalesce(l.{c},'')<>coalesce(r.{c},'')" for c in ('issue','resolution','error_excerpt','tags','notes','created_at','updated_at','author','author_email'))})",
    "sync_resolve": f"SELECT fix_key AS id, r.issue, r.resolution, coalesce(nullif(r.error_excerpt,''),nullif(l.error_excerpt,'')) AS error_excerpt, nullif(array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat(string_split(coalesce(l.tags,''),','),string_split(coalesce(r.tags,''),',')), lambda t: trim(t)), lambda t: t<>''))),','),'') AS tags, nullif(concat_ws(chr(10)||chr(10), CASE WHEN l.notes<>'' THEN '### Local Notes:'||chr(10)||l.notes END, CASE WHEN r.notes<>'' THEN '### Remote Notes:'||chr(10)||r.notes END, CASE WHEN l.resolution IS DISTINCT FROM r.resolution THEN '### Local Resolution (merged):'||chr(10)||l.resolution END),'') AS notes, l.created_at, r.updated_at, coalesce(nullif(r.author,''),nullif(l.author,'')) AS author, coalesce(nullif(r.author_email,''),nullif(l.author_email,'')) AS author_email, false AS is_private FROM {_cur('fixes')} l JOIN {_cur('fixes_remote')} r USING (fix_key)",
    "pending_older": f"WITH s AS ({_SESSIONS}) SELECT p.cwd, p.command_family, count(DISTINCT p.session_id) AS sessions, count(*) AS errors FROM pending_errors p JOIN s ON p.cwd IS NOT DISTINCT FROM s.cwd AND p.command_family IS NOT DISTINCT FROM s.command_family WHERE p.status='pending' AND p.session_id<>s.session_id GROUP BY 1,2",
    "pending_resolved": f"WITH b AS (SELECT min(seq) AS f FROM pending_errors WHERE status='pending' GROUP BY error_code, coalesce({_LINE},''), CASE WHEN coalesce(error_code,'')='' THEN seq END) SELECT seq, error_id FROM pending_errors WHERE seq IN (SELECT f FROM b WHERE f % 3 <> 0)",
    "pending_kinds": "SELECT CASE WHEN resource_address='terraform.init' THEN 'terraform_init' WHEN regexp_matches(coalesce(resource_address,''),'^(variable|output|local|module)[.]') THEN 'terraform_config' ELSE 'resource' END AS kind, count(*) AS n FROM pending_errors GROUP BY 1",
    "sync_merge_tags": f"SELECT l.fix_key, array_to_string(list_sort(list_distinct(list_concat({_COMMA.format(t='l.tags')}, {_COMMA.format(t='r.tags')}))),',') AS tags FROM {_cur('fixes')} l JOIN {_cur('fixes_remote')} r USING (fix_key)",
    "sync_status": f"SELECT count(*) FILTER (r.id IS NULL) AS ahead, count(*) FILTER (l.id IS NULL) AS behind, count(*) FILTER (r.id IS NOT NULL AND l.id IS NOT NULL) AS common, count(*) FILTER (l.is_private) AS private, count(*) FILTER (l.id IS NOT NULL AND NOT coalesce(l.is_private,false)) AS pushable, CASE WHEN count(*) FILTER (r.id IS NULL)>0 AND count(*) FILTER (l.id IS NULL)>0 THEN 'diverged' WHEN count(*) FILTER (r.id IS NULL)>0 THEN 'ahead' WHEN count(*) FILTER (l.id IS NULL)>0 THEN 'behind' ELSE 'up_to_date' END AS state FROM {_cur('fixes')} l FULL JOIN {_cur('fixes_remote')} r USING (fix_key)",
    "conflict_log": "SELECT conflict_type, count(*) AS n, count(DISTINCT lower(trim(fix_id))) AS fixes, CAST(max(detected_at) AT TIME ZONE 'UTC' AS TIMESTAMP) AS last FROM sync_conflicts GROUP BY 1",
}

"""Queries of plans and their risk: on the uploaded plans, and on stand-ins that SQL can state too.

A stand-in takes orders for plans and their lines for resources; another takes sessions of deferred
errors for plans and the addresses that failed for resources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import plan as P
from tracewright.operators import risk as R
from tracewright.operators.current import current_rows
from tracewright.sources.scratch import settle, spread
from tracewright.sources.tables import load

NOW_US = 1_767_225_600_000_000  # 2026-01-01, the injected "now"
#: Types of the stand-in's resources, by part.
TYPES = ["aws_iam_role_policy", "aws_security_group_rule", "azurerm_role_assignment", "aws_instance", "aws_s3_bucket", "google_project_iam_member", "azurerm_subnet", "aws_lambda_function"]
FIX_COLUMNS = ["seq", "id", "issue", "resolution", "error_excerpt", "tags", "created_at"]


def _fixes(spark: SparkSession, d: str) -> DataFrame:
    return current_rows(load(spark, d, "fixes"), FIX_COLUMNS)


def _first_uploads(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "plans")
    upload = F.struct("received_at", F.xxhash64("payload").alias("content"))
    return rows.groupBy("plan_id").agg(F.min_by("payload", upload).alias("payload"))


def plan_resources(spark: SparkSession, d: str) -> DataFrame:
    """The resources of every uploaded plan, its first upload."""
    return P.resources(_first_uploads(spark, d), "plan_id", "payload").select("plan_id", "ord", "address", "resource_type", "cloud_provider", "action", "module")


def plan_summary(spark: SparkSession, d: str) -> DataFrame:
    """Changing resources of every uploaded plan by action, provider and type."""
    return P.summary(P.resources(_first_uploads(spark, d), "plan_id", "payload"), "plan_id")


def plan_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The values after every change, without secrets."""
    rows = P.resources(_first_uploads(spark, d), "plan_id", "payload")
    return rows.select("plan_id", "ord", P.redacted(F.col("after"), F.col("sensitive")).alias("after"))


def plan_risk(spark: SparkSession, d: str) -> DataFrame:
    """line, markdown and json of the risk of every uploaded plan, with history and checks (no graphs are uploaded)."""
    nodes = settle(P.nodes(P.resources(_first_uploads(spark, d), "plan_id", "payload")), "nodes")
    fixes = _fixes(spark, d)
    relevant = settle(R.relevant_fixes(nodes, fixes, "plan_id", NOW_US), "relevant")
    facts = settle(R.scored(R.facts(nodes, "plan_id", None, R.qualifying(relevant, "plan_id"))), "facts")
    none = spark.createDataFrame([], "plan_id string, place int, target string, depth int, path array<string>")
    return R.reports(facts, none, R.explanations(nodes, facts, "plan_id"), R.checks(nodes, relevant, fixes, "plan_id"), relevant, fixes, "plan_id")


def _order_nodes(spark: SparkSession, d: str) -> DataFrame:
    rt = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("l_partkey") % len(TYPES) + 1).cast("int"))
    action = F.when(F.col("l_returnflag") == "A", "create").when(F.col("l_returnflag") == "R", "delete").otherwise("update")
    percent = lambda c: F.round(F.col(c) * 100).cast("int").cast("string")
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    before = F.create_map(F.lit("acl"), quoted("l_linestatus"), F.lit("ami"), percent("l_tax"), F.lit("id"), F.col("l_partkey").cast("string"))
    after = F.create_map(F.lit("acl"), F.lit('"O"'), F.lit("ami"), percent("l_discount"), F.lit("id"), F.col("l_suppkey").cast("string"), F.lit("ingress"), F.col("l_linenumber").cast("string"))
    rows = spread(load(spark, d, "lineitem")).select(
        F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("ord"), F.concat(rt, F.lit(".r"), F.col("l_suppkey").cast("string")).alias("address"), rt.alias("resource_type"),
        action.alias("action"), before.alias("before"), after.alias("after"),
    )
    return settle(P.nodes(rows), "nodes")  # read by several steps


def _order_edges(spark: SparkSession, d: str) -> DataFrame:
    """What depends on a line's resource, on that, and on what control points depend on."""
    n = load(spark, d, "lineitem")
    rt = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("l_partkey") % len(TYPES) + 1).cast("int"))
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    address = text(rt, ".r", F.col("l_suppkey"))
    near = text("dep.d", F.col("l_linenumber") % 3, "_", F.col("l_partkey") % 5)
    base = text("base.b", F.col("l_linenumber") % 2)
    edge = lambda a, b: F.struct(a.alias("src"), b.alias("dst"))
    edges = F.array_compact(F.array(edge(near, address), edge(text("far.f", F.col("l_linenumber") % 2), near), edge(text("side.s", F.col("l_linenumber") % 2), base), F.when(R.is_boundary(rt), edge(address, base))))
    return n.select(F.col("l_orderkey").alias("plan_id"), F.inline(edges))


def risk_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The changing resources of every order with control point and fingerprint."""
    return _order_nodes(spark, d).select("plan_id", "ord", "address", "action", "is_control_point", "category", "criticality", F.array_join("changed_attrs", ",").alias("attrs"), F.array_join("attr_categories", ",").alias("categories"))


def risk_affected(spark: SparkSession, d: str) -> DataFrame:
    """What the changes of every order reach, with the least shortest path."""
    return R.affected(_order_nodes(spark, d), _order_edges(spark, d), "plan_id").select("plan_id", "node", "depth", F.array_join("path", ">").alias("path"))


def _order_facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes = _order_nodes(spark, d)
    reached = settle(R.affected(nodes, _order_edges(spark, d), "plan_id"), "affected")
    history = load(spark, d, "orders").select(F.col("o_orderkey").alias("plan_id"), (F.col("o_custkey") % 5).cast("int").alias("history"))
    return nodes, R.facts(nodes, "plan_id", reached, history)


def risk_score(spark: SparkSession, d: str) -> DataFrame:
    """Score, severity and what they are made of, of every order."""
    f = R.scored(_order_facts(spark, d)[1])
    return f.select("plan_id", "changes", "control_points", "l1", "l2", "greenfield", "score", "severity", R.at_least(F.col("severity"), "high").alias("blocks"))


def risk_severities(spark: SparkSession, d: str) -> DataFrame:
    """Orders by severity."""
    return risk_score(spark, d).groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))


def risk_explanations(spark: SparkSession, d: str) -> DataFrame:
    """What the score of every order is made of, line by line."""
    nodes, f = _order_facts(spark, d)
    return R.explanations(nodes, f, "plan_id")


def risk_checks(spark: SparkSession, d: str) -> DataFrame:
    """What to check in every order."""
    return R.checks(_order_nodes(spark, d), None, None, "plan_id")


def risk_category_checks(spark: SparkSession, d: str) -> DataFrame:
    """The checks of the categories of every order."""
    return R.category_checks(_order_nodes(spark, d), "plan_id")


def _session_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of deferred errors as plans: the addresses that failed, with what their command does."""
    rows = load(spark, d, "pending_errors").where("session_id is not null and resource_address is not null")
    first = rows.groupBy("session_id", F.col("resource_address").alias("address")).agg(F.min_by(F.struct("seq", "command_family"), "seq").alias("r"))
    rt = F.regexp_extract("address", r"(\w+)\.[^.]+$", 1)
    action = F.when(F.col("r.command_family") == "terraform destroy", "delete").when(F.col("r.command_family") == "terraform apply", "update").otherwise("create")
    none = F.create_map().cast("map<string,string>")
    after = F.create_map(F.lit("tags"), F.lit("1"), F.lit("policy"), F.lit("1"))
    rows = first.select(F.col("session_id").alias("plan_id"), F.col("r.seq").alias("ord"), "address", rt.alias("resource_type"), action.alias("action"), none.alias("before"), after.alias("after"))
    return settle(P.nodes(rows), "nodes")  # read by several steps


def relevant_fixes(spark: SparkSession, d: str) -> DataFrame:
    """The ten fixes that matter most to every session."""
    got = R.relevant_fixes(_session_nodes(spark, d), _fixes(spark, d), "plan_id", NOW_US)
    return got.withColumn("supporting", F.array_join("supporting", ","))


def qualifying_history(spark: SparkSession, d: str) -> DataFrame:
    """How many fixes count for the score of every session."""
    return R.qualifying(R.relevant_fixes(_session_nodes(spark, d), _fixes(spark, d), "plan_id", NOW_US), "plan_id")


def type_history(spark: SparkSession, d: str) -> DataFrame:
    """How many fixes have the type of a session's resource within their tags."""
    return R.type_counts(_session_nodes(spark, d), _fixes(spark, d), "plan_id")


def prior_fixes(spark: SparkSession, d: str) -> DataFrame:
    """The ten fixes of every session by type alone."""
    return R.prior_fixes(_session_nodes(spark, d), _fixes(spark, d), "plan_id")


def history_prior(spark: SparkSession, d: str) -> DataFrame:
    """At most three fixes of every session by address, or type and concern."""
    return R.history_prior(_session_nodes(spark, d), _fixes(spark, d), "plan_id")


QUERIES = {
    f.__name__: f
    for f in (plan_resources, plan_summary, plan_redacted, plan_risk, risk_nodes, risk_affected, risk_score, risk_severities, risk_explanations, risk_checks, risk_category_checks, relevant_fixes, qualifying_history, type_history, prior_fixes, history_prior)
}

_TYPES = "['aws_iam_role_policy','aws_security_group_rule','azurerm_role_assignment','aws_instance','aws_s3_bucket','google_project_iam_member','azurerm_subnet','aws_lambda_function']"
_N = f"""n0 AS (SELECT l_orderkey AS plan_id, l_linenumber AS ord, {_TYPES}[l_partkey % 8 + 1] AS rt, l_suppkey, l_partkey, CASE l_returnflag WHEN 'A' THEN 'create' WHEN 'R' THEN 'delete' ELSE 'update' END AS action, l_linestatus, CAST(round(l_tax*100) AS INT) AS tax, CAST(round(l_discount*100) AS INT) AS disc FROM lineitem),
n AS (SELECT plan_id, ord, rt, rt || '.r' || l_suppkey AS address, action, l_partkey, CASE WHEN starts_with(rt,'aws_iam_role_policy') OR starts_with(rt,'google_project_iam') THEN 'iam' WHEN starts_with(rt,'aws_security_group') THEN 'network' WHEN starts_with(rt,'azurerm_role_assignment') THEN 'rbac' ELSE '' END AS category,
 CASE WHEN starts_with(rt,'aws_iam_role_policy') OR starts_with(rt,'google_project_iam') OR starts_with(rt,'azurerm_role_assignment') THEN 0.9 WHEN starts_with(rt,'aws_security_group') THEN 0.8 ELSE 0.0 END AS criticality,
 list_filter([CASE WHEN action<>'update' OR l_linestatus<>'O' THEN 'acl' END, CASE WHEN action<>'update' OR tax<>disc THEN 'ami' END, CASE WHEN action<>'delete' THEN 'ingress' END], lambda x: x IS NOT NULL) AS attrs FROM n0)"""
_E = """e AS (SELECT plan_id, address AS dst, 'dep.d' || (ord % 3) || '_' || (l_partkey % 5) AS near, 'far.f' || (ord % 2) AS far, 'base.b' || (ord % 2) AS base, 'side.s' || (ord % 2) AS side, category FROM n),
deep AS (SELECT plan_id, bool_or(category<>'' OR action='delete') AS deep FROM n GROUP BY 1),
r1 AS (SELECT plan_id, near AS node, 1 AS depth, min([dst, near]) AS path FROM e GROUP BY 1,2 UNION ALL SELECT plan_id, side, 1, min([base, side]) FROM e WHERE category<>'' GROUP BY 1,2),
r2 AS (SELECT e.plan_id, far AS node, 2 AS depth, min(list_append(r1.path, far)) AS path FROM e JOIN r1 ON e.plan_id=r1.plan_id AND e.near=r1.node JOIN deep ON deep.plan_id=e.plan_id WHERE deep GROUP BY 1,2),
a AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2)"""
_F = """f0 AS (SELECT n.plan_id, count(*) AS changes, count(*) FILTER (category<>'') AS control_points, bool_and(action='create') AS greenfield, bool_and(action='update' AND category='') AS plain, sum(CAST(CASE action WHEN 'create' THEN 8 WHEN 'delete' THEN 20 ELSE 5 END AS DECIMAL(12,4)) * CASE WHEN category<>'' THEN 1.5 ELSE 1.0 END) AS p, sum(CAST(CASE WHEN category<>'' THEN 6 ELSE 2.4 END AS DECIMAL(12,4))) AS q, sum(CASE WHEN action='update' AND category IN ('iam','rbac') AND false THEN 8 ELSE 0 END) AS s FROM n GROUP BY 1),
f AS (SELECT f0.*, coalesce((SELECT count(*) FROM a WHERE a.plan_id=f0.plan_id AND depth=1),0) AS l1, coalesce((SELECT count(*) FROM a WHERE a.plan_id=f0.plan_id AND depth=2),0) AS l2, coalesce((SELECT o_custkey % 5 FROM orders WHERE o_orderkey=f0.plan_id),0) AS history FROM f0),
g AS (SELECT *, least(l1+l2,25) AS impacted, CAST(least(l1+l2,25) AS DECIMAL(12,4)) * CASE WHEN greenfield THEN 0.375 WHEN plain THEN 0.5 ELSE 1.5 END AS gain, CAST(CASE WHEN greenfield THEN q ELSE p END AS DECIMAL(20,4)) AS points FROM f),
h AS (SELECT *, CAST(round_even(least(100, greatest(0, CASE WHEN greenfield AND l1+l2=0 THEN least(45, points+gain+least(history*5,15)) ELSE points+gain+least(history*5,15) END)), 1) AS DECIMAL(5,1)) AS score FROM g)"""
_SEV = "CASE WHEN score>=75 THEN 'critical' WHEN score>=50 THEN 'high' WHEN score>=25 THEN 'medium' ELSE 'low' END"
_CHECKS = "CASE category WHEN 'iam' THEN ['Review IAM policy least-privilege before applying','Check service account permissions'] WHEN 'rbac' THEN ['Review RBAC role assignment scope','Verify key vault access policy changes'] WHEN 'network' THEN ['Verify security group rules','Check for open 0.0.0.0/0 rules'] END"
_AT = "epoch_us(TRY_CAST(CASE WHEN regexp_matches(trim({c}),'(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') THEN trim({c}) ELSE trim({c})||'Z' END AS TIMESTAMPTZ))"
_FIX = f"fx AS (SELECT *, lower(concat_ws(' ', nullif(issue,''), nullif(resolution,''), nullif(error_excerpt,''))) AS t, list_distinct(list_filter(list_transform(string_split(coalesce(tags,''),','), lambda t: lower(trim(t))), lambda t: t<>'')) AS tl FROM fixes QUALIFY row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY coalesce({_AT.format(c='updated_at')}, -9223372036854775807) DESC, seq DESC)=1)"
_S = """s AS (SELECT session_id AS plan_id, resource_address AS address, min(seq) AS ord, arg_min(command_family, seq) AS fam FROM pending_errors WHERE session_id IS NOT NULL AND resource_address IS NOT NULL GROUP BY 1,2),
m AS (SELECT *, regexp_extract(address, '(\\w+)\\.[^.]+$', 1) AS rt, CASE fam WHEN 'terraform destroy' THEN 'delete' WHEN 'terraform apply' THEN 'update' ELSE 'create' END AS action, lower(split_part(address,'[',1)) AS whole, lower(array_to_string(string_split(address,'.')[-2:], '.')) AS leaf, lower(regexp_replace(regexp_extract(address,'^((?:module\\.[^.]+\\.)*)',1),'\\.$','')) AS mod FROM s)"""
_W = "w AS (SELECT seq, list_distinct(regexp_extract_all(t, '\\w+')) AS words FROM fx), tok AS (SELECT DISTINCT seq, unnest(list_concat(words, tl)) AS x FROM w JOIN fx USING (seq))"
_REL = (
    f"WITH {_S}, {_FIX}, {_W}, "
    "ad AS (SELECT DISTINCT whole, leaf FROM m WHERE contains(address,'.')), hit AS (SELECT whole, leaf, seq FROM ad JOIN fx ON contains(t, whole) OR contains(t, leaf)), "
    "pr AS (SELECT DISTINCT plan_id, ord, seq FROM (SELECT plan_id, ord, seq FROM m JOIN tok ON tok.x = lower(m.rt) WHERE m.rt<>'' UNION ALL SELECT plan_id, ord, seq FROM m JOIN hit USING (whole, leaf))), "
    "c AS (SELECT m.plan_id, m.ord, m.address, m.action, fx.seq, fx.created_at, t, tl, words, mod, lower(m.rt) AS rt, list_contains(tl, lower(m.rt)) AS tag, list_contains(words, lower(m.rt)) AND m.rt<>'' AS txt, contains(t, whole) OR contains(t, leaf) AS adr, "
    "len(list_filter(regexp_extract_all(t, '(?:api error |error:\\s*|code[:\\s]*[\"'']?)(\\w+(?:\\.\\w+)*)', 1), lambda k: length(k)>3 AND k NOT IN ('error','failed','true','false')))>0 AS code, coalesce(floor((" + str(NOW_US) + f" - {_AT.format(c='fx.created_at')}) / 86400000000.0) < 90, false) AS recent FROM pr JOIN m USING (plan_id, ord) JOIN fx USING (seq) JOIN w USING (seq)), "
    "k AS (SELECT *, (tag OR txt) AND rt<>'' AND code AS k1, adr AS k2, (tag OR txt) AND action<>'delete' AND rt<>'' AND list_has_any(words, ['tags','policy']) AS k3, (tag OR txt) AND action<>'delete' AND rt<>'' AND list_has_any(tl, ['metadata','iam']) AS k4, tag AND contains(t, action) AS k5, mod<>'' AND contains(t, mod) AS km FROM c), "
    "b AS (SELECT *, CASE WHEN k1 THEN 150 WHEN k2 THEN 120 WHEN k3 THEN 100 WHEN k4 THEN 80 WHEN k5 THEN 60 WHEN tag AND rt<>'' THEN 40 WHEN txt THEN 20 END AS base FROM k), "
    "t2 AS (SELECT *, CASE base WHEN 150 THEN 'error_code' WHEN 120 THEN 'address' WHEN 100 THEN 'attribute' WHEN 80 THEN 'category' WHEN 60 THEN 'type_action' WHEN 40 THEN 'resource_type_tag' ELSE 'resource_type_text' END AS signal, array_to_string(list_filter([CASE WHEN k3 AND base>100 THEN 'attribute' END, CASE WHEN k4 AND base>80 THEN 'category' END, CASE WHEN k5 AND base>60 THEN 'type_action' END, CASE WHEN km THEN 'module_path' END, CASE WHEN recent THEN 'recency' END], lambda x: x IS NOT NULL), ',') AS supporting, base + CASE WHEN km THEN 20 ELSE 0 END + CASE WHEN recent THEN 30 ELSE 0 END AS total FROM b WHERE base IS NOT NULL), "
    "u AS (SELECT plan_id, seq, arg_max(row(signal, supporting), row(total, -ord)) AS x, max(total) AS score, count(*) AS matched, min(address) AS resource, any_value(coalesce(created_at,'')) AS dt FROM t2 GROUP BY 1,2), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY score DESC, length(dt) DESC, dt, seq) AS place FROM u), "
    "rel AS (SELECT plan_id, place, seq, score, x[1] AS signal, x[2] AS supporting, CASE WHEN score>=120 THEN 'high' WHEN score>=60 THEN 'medium' ELSE 'low' END AS confidence, matched, resource FROM rk WHERE place<=10) "
)
SQL = {
    "risk_nodes": f"WITH {_N} SELECT plan_id, ord, address, action, category<>'' AS is_control_point, category, CAST(criticality AS DOUBLE) AS criticality, array_to_string(attrs,',') AS attrs, array_to_string(list_sort(list_distinct(list_transform(attrs, lambda x: CASE x WHEN 'acl' THEN 'access' WHEN 'ami' THEN 'image' ELSE 'networking' END))),',') AS categories FROM n",
    "risk_affected": f"WITH {_N}, {_E} SELECT plan_id, node, depth, array_to_string(path, '>') AS path FROM a",
    "risk_score": f"WITH {_N}, {_E}, {_F} SELECT plan_id, changes, control_points, l1, l2, greenfield, score, {_SEV} AS severity, score>=50 AS blocks FROM h",
    "risk_severities": f"WITH {_N}, {_E}, {_F} SELECT {_SEV} AS severity, count(*) AS n, min(score) AS least, max(score) AS most FROM h GROUP BY 1",
    "risk_explanations": f"""WITH {_N}, {_E}, {_F} SELECT n.plan_id, ord, 0 AS sub, action || ' ' || address || CASE WHEN category<>'' AND greenfield THEN ' (boundary resource, greenfield)' WHEN category<>'' THEN ' (boundary resource)' WHEN greenfield THEN ' (greenfield)' ELSE '' END AS label,
        CAST(round_even(CAST(CASE action WHEN 'create' THEN 8 WHEN 'delete' THEN 20 ELSE 5 END AS DECIMAL(12,4)) * CASE WHEN category<>'' THEN 1.5 ELSE 1.0 END * CASE WHEN NOT greenfield THEN 1.0 WHEN category<>'' THEN 0.5 ELSE 0.3 END, 1) AS DECIMAL(12,1)) AS delta, 'action' AS kind FROM n JOIN h USING (plan_id)
      UNION ALL SELECT plan_id, 2147483647, 0, impacted || ' downstream resource(s) affected via dependency graph', CAST(round_even(gain, 1) AS DECIMAL(12,1)), 'impact' FROM h WHERE impacted>0
      UNION ALL SELECT plan_id, 2147483647, 1, 'Prior similar incident' || CASE WHEN history>1 THEN 's' ELSE '' END || ' detected in fix history (' || history || ' match' || CASE WHEN history>1 THEN 'es' ELSE '' END || ')', least(history*5,15), 'history' FROM h WHERE history>0
      UNION ALL SELECT plan_id, 2147483647, 2, 'Greenfield plan (all creates, no cross-boundary impact) — capped at MEDIUM', 0, 'modifier' FROM h WHERE greenfield AND l1+l2=0""",
    "risk_checks": f"""WITH {_N}, x AS (SELECT plan_id, ord, address, rt, unnest(attrs) AS attr, generate_subscripts(attrs,1)-1 AS sub FROM n), y AS (SELECT *, CASE WHEN rt='aws_instance' AND attr='ami' THEN 'Confirm AMI exists and is shared to this account' WHEN rt='aws_s3_bucket' AND attr='acl' THEN 'Review bucket ACL — prefer bucket policies over ACLs' END AS c FROM x),
      z AS (SELECT plan_id, category, min(ord) AS ord, arg_min(address, row(ord,address)) AS address FROM n WHERE category<>'' GROUP BY 1,2)
      SELECT plan_id, 1 AS step, min(ord) AS ord, arg_min(sub, row(ord,sub,address)) AS sub, c AS check, 'attribute' AS source, arg_min(address, row(ord,sub,address)) AS resource FROM y WHERE c IS NOT NULL GROUP BY plan_id, c
      UNION ALL SELECT plan_id, 3, ord, generate_subscripts({_CHECKS},1)-1, unnest({_CHECKS}), 'category', address FROM z
      UNION ALL SELECT DISTINCT plan_id, 4, 0, 0, 'Confirm resource is not referenced by other stacks', 'category', '' FROM n WHERE action='delete'""",
    "risk_category_checks": f"WITH {_N} SELECT DISTINCT plan_id, unnest({_CHECKS}) AS check FROM n WHERE category<>'' UNION ALL SELECT DISTINCT plan_id, 'Confirm resource is not referenced by other stacks' FROM n WHERE action='delete'",
    "relevant_fixes": _REL + "SELECT * FROM rel",
    "qualifying_history": _REL + "SELECT plan_id, CAST(least(count(*),3) AS INT) AS history FROM rel WHERE confidence='high' OR (confidence='medium' AND supporting<>'') GROUP BY 1",
    "type_history": f"WITH {_S}, {_FIX}, tg AS (SELECT rt, seq FROM (SELECT DISTINCT rt FROM m) JOIN fx ON contains(lower(tags), lower(rt)) WHERE rt<>'') SELECT plan_id, address, count(*) AS n FROM m JOIN tg USING (rt) GROUP BY 1,2",
    "prior_fixes": f"WITH {_S}, {_FIX}, {_W}, tg AS (SELECT rt, seq, max(score) AS score FROM (SELECT rt, seq, 100 AS score FROM (SELECT DISTINCT rt FROM m WHERE rt<>'') JOIN fx ON contains(lower(tags), lower(rt)) UNION ALL SELECT DISTINCT rt, seq, 60 FROM m JOIN (SELECT seq, unnest(words) AS x FROM w) ON x=lower(rt)) GROUP BY 1,2), u AS (SELECT plan_id, seq, max(score) AS score, count(DISTINCT address) AS matched FROM m JOIN tg USING (rt) GROUP BY 1,2), r AS (SELECT u.*, row_number() OVER (PARTITION BY plan_id ORDER BY score DESC, coalesce(created_at,'') DESC, id) AS place FROM u JOIN fx USING (seq)) SELECT plan_id, place, seq, score, CASE WHEN score=100 THEN 'tag_match' ELSE 'text_match' END AS reason, matched FROM r WHERE place<=10",
    "history_prior": f"""WITH {_S}, {_FIX}, i AS (SELECT *, lower(concat_ws(' ', nullif(issue,''), nullif(error_excerpt,''))) AS ie FROM fx), cp AS (SELECT *, regexp_matches(lower(rt), '^(aws_iam_(role|policy|user|group)|azurerm_(role_assignment|key_vault_access_policy|role_definition|network_security_group|firewall_rule)|google_(project_iam|service_account|compute_firewall)|aws_(security_group|network_acl|route_table))') OR action='delete' AS hard FROM m),
      p AS (SELECT plan_id, seq FROM cp JOIN i ON contains(ie, lower(address)) UNION SELECT plan_id, seq FROM cp JOIN i ON contains(lower(tags), lower(rt)) AND rt<>'' AND list_has_any(tl, ['networking','network','rbac','iam','dns','quota','state','state-lock','auth','authentication','authorization','acl','route','routing','connectivity','ingress','egress','security','firewall','k8s','kubernetes','key_vault','vault','certificate','cert','database','db','storage','permissions']) WHERE plan_id IN (SELECT plan_id FROM cp GROUP BY 1 HAVING bool_or(hard))),
      q AS (SELECT plan_id, arg_max(seq, row(CASE WHEN coalesce(error_excerpt,'')<>'' THEN 1 ELSE 0 END, coalesce(created_at,''), -seq)) AS seq FROM p JOIN fx USING (seq) GROUP BY plan_id, coalesce(nullif(regexp_extract(issue,'[A-Z][a-z]+(?:[A-Z][a-z]+)+',0),''), array_to_string(list_slice(list_filter(string_split_regex(lower(regexp_replace(issue,'[^\\w\\s]','','g')),'\\s+'), lambda x: x<>''),1,4),' '))),
      r AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY seq) AS place FROM q) SELECT plan_id, place, seq FROM r WHERE place<=3""",
}

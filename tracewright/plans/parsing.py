"""Queries of parsing: error rows from tool output, and what is made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import kubernetes as K
from tracewright.operators import parse
from tracewright.operators import terraform as T
from tracewright.sources.tables import load

_TF = ["error_no", "error_message", "resource_type", "resource_name", "resource_address", "file", "line", "error_code", "cloud_provider", "terraform_action", "module_path"]
_K8S = ["error_no", "error_message", "resource_type", "resource_name", "namespace", "file", "error_code", "severity", "k8s_error_type", "pod_name", "container_name", "exit_code", "restart_count", "helm_release", "helm_chart"]


def _lists(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns, F.array_join("tags", ",").alias("tags"), F.array_join("suggestions", " / ").alias("suggestions"))


def source_route(spark: SparkSession, d: str) -> DataFrame:
    """Which tool each document comes from."""
    return load(spark, d, "documents").select("doc_id", parse.source(F.col("text")).alias("tool"))


def parsed_terraform(spark: SparkSession, d: str) -> DataFrame:
    """The Terraform errors of every document."""
    rows = T.parse_terraform(load(spark, d, "documents").select("doc_id", "text"), "text")
    return _lists(rows, ["doc_id", *_TF])


def parsed_kubernetes(spark: SparkSession, d: str) -> DataFrame:
    """The kubectl and Helm errors of every document."""
    rows = K.parse_kubernetes(load(spark, d, "documents").select("doc_id", "text"), "text")
    return _lists(rows, ["doc_id", *_K8S])


def _excerpts(spark: SparkSession, d: str) -> DataFrame:
    return parse.parse_errors(load(spark, d, "pending_errors").select("seq", "error_excerpt"), "error_excerpt")


def parsed_errors(spark: SparkSession, d: str) -> DataFrame:
    """The typed errors of every excerpt, each text read by the parser its source calls for."""
    return _excerpts(spark, d).select("seq", "source", "error_no", "error_type", "resource_type", "resource_address", "resource_name", "error_code", "file", "line", "error_id")


def parsed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Parsed errors by source, provider and code."""
    return _excerpts(spark, d).groupBy("source", F.coalesce("cloud_provider", F.lit("-")).alias("provider"), "error_code").agg(F.count(F.lit(1)).alias("n"))


def parsed_pending(spark: SparkSession, d: str) -> DataFrame:
    """Deferred errors made of the first error of every excerpt."""
    errors = parse.first_errors(_excerpts(spark, d), ["seq"])
    return parse.to_pending(errors, ["seq"]).select("seq", "error_type", "short_message", "tags", "file", "kind")


def parsed_fixes(spark: SparkSession, d: str) -> DataFrame:
    """Fix rows made of the first error of every excerpt, with the rows' own tags merged in."""
    errors = parse.first_errors(_excerpts(spark, d), ["seq"]).join(load(spark, d, "pending_errors").select("seq", F.col("tags").alias("own")), "seq")
    return parse.to_fixes(errors, ["seq"], F.lit(None).cast("string"), F.col("own")).select("seq", "issue", "tags")


def error_summaries(spark: SparkSession, d: str) -> DataFrame:
    """One line for the errors of every document."""
    return parse.summary(parse.parse_errors(load(spark, d, "documents").select("doc_id", "text"), "text"), ["doc_id"])


QUERIES = {f.__name__: f for f in (source_route, parsed_terraform, parsed_kubernetes, parsed_errors, parsed_counts, parsed_pending, parsed_fixes, error_summaries)}


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _x(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, {_q(pattern)}, {group}), '')"


def _m(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {_q(pattern)})"


def _flat(text: str) -> str:
    """White space as single blanks, none at the ends, 500 characters."""
    return f"substr(trim(regexp_replace({text}, '\\s+', ' ', 'g')), 1, 500)"


def _list(values: list[str]) -> str:
    return _q(" / ".join(values))


_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def _route(text: str) -> str:
    helm = " OR ".join(f"contains(lower({text}), {_q(w)})" for w in ("helm install", "helm upgrade", "helm rollback", "installation failed", "upgrade failed", "rollback failed", "helm template", 'release "'))
    k8s = " OR ".join(_m(text, "(?i)" + p) for p in (r"kubectl\s+(apply|create|delete|get|describe)", r"helm\s+(install|upgrade|rollback|template)", "Error from server|error when creating|ImagePullBackOff|CrashLoopBackOff|OOMKilled|CreateContainerConfigError|FailedScheduling", r"pod/[a-z0-9-]+", r"deployment\.apps/|service/", r"namespace:[^\n]*\s+\w+", r"kubectl[^\n]*-n\s+\w+", r"\.yaml[^\n]*error"))
    tf = " OR ".join(_m(text, "(?i)" + p) for p in ("Error:", r"(aws|azurerm|google)_\w+\.", r"\.tf\s+line\s+\d+", r"with\s+\w+\.\w+", r"Plan:[^\n]*to add[^\n]*to change[^\n]*to destroy", r"terraform\s+(init|plan|apply)"))
    return f"CASE WHEN {helm} THEN 'helm' WHEN {k8s} THEN 'kubernetes' WHEN {tf} THEN 'terraform' ELSE 'unknown' END"


def _terraform(table: str, key: str, text: str, where: str = "true") -> str:
    """The Terraform rows of a table, as a query."""
    config = "CASE " + " ".join(f"WHEN contains(lower(regexp_extract(b, 'Error:\\s*([^\\n]+)', 1)), {_q(p)}) THEN '{c}'" for p, c in T.CONFIG_ERRORS.items()) + " END"
    codes = lambda names: "CASE " + " ".join(f"WHEN contains(b, '{c}') THEN '{c}'" for c in sorted(names, key=lambda c: (-len(c), c))) + " END"
    with_, named, defined, doing = T.WITH, T.NAMED, T.DEFINED, T.DOING
    kind4 = f"lower(replace({_STRIP.format(_x('c', doing))}, ' ', '_'))"
    case = lambda a, b_, c_, d_, e_, f_: f"CASE WHEN {_m('c', with_)} THEN {a} WHEN {_m('c', named)} THEN {b_} WHEN {_m('c', defined)} THEN {c_} WHEN {_m('c', doing)} THEN {d_} {e_} WHEN cfg IN ('InconsistentLockFile', 'ModuleNotInstalled', 'ProviderQueryFailed') THEN {f_} ELSE 'unknown' END"
    scope = lambda form: " ".join(f"WHEN {_m('c', p)} THEN {form(s, _x('c', p))}" for s in ("variable", "local", "output", "module") for p in [f'in {s} "([a-zA-Z0-9_-]+)"'])
    address = case(_x("c", with_), f"{_x('c', named)} || '.' || {_x('c', named, 2)}", f"{_x('c', defined)} || '.' || {_x('c', defined, 2)}", f"{kind4} || '.' || {_STRIP.format(_x('c', doing, 2))}", scope(lambda s, n: f"'{s}.' || {n}"), "'terraform.init'")
    kind = case(_x("c", with_, 2), _x("c", named), _x("c", defined), kind4, scope(lambda s, n: f"'{s}'"), "'terraform'")
    name = case(_x("c", with_, 3), _x("c", named, 2), _x("c", defined, 2), _STRIP.format(_x("c", doing, 2)), scope(lambda s, n: n), "'init'")
    provider = "CASE WHEN starts_with(resource_type,'aws_') THEN 'aws' WHEN starts_with(resource_type,'azurerm_') THEN 'azure' WHEN starts_with(resource_type,'google_') THEN 'gcp' " + " ".join(f"WHEN {_m('b', p)} THEN '{n}'" for n, p in (("aws", r"(?i)\baws_[a-z_]+\b"), ("azure", r"(?i)\bazurerm_[a-z_]+\b"), ("gcp", r"(?i)\bgoogle_[a-z_]+\b"), ("aws", r"(?i)arn:aws:|amazonaws\.com|aws-sdk|ec2:|s3:|iam:|lambda:"), ("azure", r"(?i)azure\.com|microsoft\.com|\.azure\.|subscription[^\n]*resource\s*group"), ("gcp", r"(?i)googleapis\.com|gcloud|projects/[^/]+/"))) + " ELSE 'unknown' END"
    tips = "CASE " + " ".join(f"WHEN cloud_provider='{n}' AND {_m('error_code', c) if isinstance(c, str) else 'error_code IN (' + ', '.join(map(_q, c)) + ')'}{' AND contains(lower(error_message), ' + _q('soft') + ')' if c == ['ConflictError'] else ''} THEN {_list(t)}" for n, c, t in T.ADVICE) + " ELSE '' END"
    return f"""
    SELECT *, array_to_string(list_filter(['terraform', nullif(cloud_provider,'unknown'), nullif(resource_type,'unknown'), error_code], lambda x: x IS NOT NULL), ',') AS tags,
      CASE WHEN error_code IS NULL THEN '' ELSE {tips} END AS suggestions, {_x('resource_address', '^(module[.][^.]+)')} AS module_path,
      {_x('b', r'on\s+([^\s]+\.tf)\s+line\s+\d+')} AS file, CAST({_x('b', r'on\s+[^\s]+\.tf\s+line\s+(\d+)')} AS INT) AS line,
      CASE WHEN {_m('b', '(?i)creating')} THEN 'create' WHEN {_m('b', '(?i)updating|modifying')} THEN 'update' WHEN {_m('b', '(?i)deleting|destroying')} THEN 'delete' END AS terraform_action
    FROM (SELECT *, {provider} AS cloud_provider FROM (
      SELECT {key}, b, CAST(row_number() OVER (PARTITION BY {key} ORDER BY i) AS INT) AS error_no, {address} AS resource_address, {kind} AS resource_type, {name} AS resource_name,
        coalesce({_x('b', "Code:\\s*[\"']?([A-Za-z][A-Za-z0-9_]+)[\"']?")}, {_x('b', r'(?i)api\s+error\s+([A-Za-z][A-Za-z0-9_]+):')}, {codes(T.AWS_CODES)}, {codes(T.AZURE_CODES)}, replace({_x('b', r'Status:\s*(\d+\s*[A-Za-z]+)')}, ' ', ''), {_x('b', r'StatusCode:\s*(\d+)')}, cfg) AS error_code,
        substr(regexp_replace(trim(regexp_replace(coalesce({_x('b', "(?s)Message:\\s*[\"']?(.+?)[\"']?(?:\\n│|\\n\\n|\\n?$)")}, regexp_replace(split_part(b, chr(10), 1), '^│?\\s*Error:\\s*', '')), '\\s+', ' ', 'g')), '^│\\s*', ''), 1, 500) AS error_message
      FROM (SELECT *, replace(b, '│', '') AS c, {config} AS cfg FROM (
        SELECT {key}, i, 'Error:' || CASE WHEN i = len(p) THEN p[i] ELSE regexp_replace(p[i], '│?\\s*$', '') END AS b
        FROM (SELECT {key}, p, unnest(range(2, len(p) + 1)) AS i FROM (SELECT {key}, string_split({text}, 'Error:') AS p FROM {table} WHERE {where}))
        ) WHERE length(b) > 6 QUALIFY row_number() OVER (PARTITION BY {key}, {_STRIP.format('b')} ORDER BY i) = 1)))"""


def _kubernetes(table: str, key: str, text: str, where: str = "true") -> str:
    """The kubectl and Helm rows of a table, as a query."""
    either = lambda t, p: f"coalesce({_x(t, p, 1)}, {_x(t, p, 2)})"
    null = "CAST(NULL AS VARCHAR)"
    number = "CAST(NULL AS INT)"

    def fields(message: str, kind: str, name: str, namespace: str, code: str, tags: str, k8s: str, file: str = null, severity: str = "'error'", tips: str = "''", pod: str = null, container: str = null, code_of_exit: str = number, restarts: str = number, release: str = null, chart: str = null) -> str:
        return f"{message} AS error_message, {kind} AS resource_type, {name} AS resource_name, {namespace} AS namespace, {file} AS file, {code} AS error_code, {severity} AS severity, {tips} AS suggestions, {tags} AS tags, {k8s} AS k8s_error_type, {pod} AS pod_name, {container} AS container_name, {code_of_exit} AS exit_code, {restarts} AS restart_count, {release} AS helm_release, {chart} AS helm_chart"

    t = "t"
    under, obj = r'(?i)(pods?|deployments?|services?|configmaps?|secrets?)\s+"?([^":\s]+)"?\s+is\s+(\w+)', r'(?i)(pods?|deployments?|services?|configmaps?|secrets?|statefulsets?)\s+"?([^":\s]+)"?'
    space = r"(?i)-n\s+(\S+)|namespace[=:\s]+(\S+)"
    made = "CASE WHEN contains(t,'INSTALLATION FAILED') THEN 'helm_install' WHEN contains(t,'UPGRADE FAILED') THEN 'helm_upgrade' ELSE 'unknown' END"
    release = _x(t, r'(?i)release\s+"([^"]+)"')
    is_helm = " OR ".join(_m(t, "(?i)" + p) for p in (r"helm\s+(install|upgrade|rollback)", "INSTALLATION FAILED|UPGRADE FAILED|ROLLBACK FAILED", r"Error:\s+chart\s+", r'release\s+"[^"]+"\s+'))
    pick = lambda i: "CASE " + " ".join(f"WHEN {_m(t, '(?i)' + f[0].replace('.*', '[^' + chr(92) + 'n]*'))} THEN {_q(f[1]) if i == 1 else _list(f[2])}" for f in K.HELM_FAILURES) + (" END" if i == 1 else " ELSE '' END")
    said = _x(t, r"(?s)Error:\s*(.+?)(?:\n\n|\n[A-Z]|$)")
    helm = f"SELECT {key}, 1 AS part, 1 AS i, " + fields(_flat(f"coalesce({said}, 'Helm operation failed')"), f"coalesce(lower({_x(t, under)}), 'helm_release')", f"coalesce({_x(t, under, 2)}, {release})", either(t, space), pick(1), f"'kubernetes,helm,' || {made}", made, tips=pick(2), release=release, chart=_x(t, r'(?i)chart\s+"([^"]+)"')) + f" FROM s WHERE {is_helm}"

    def cut(word: str) -> str:
        return f"(SELECT {key}, unnest(list_filter(string_split(regexp_replace(t, '(?i)({word})', chr(1) || '\\1', 'g'), chr(1)), lambda x: starts_with(lower(x), lower('{word}')))) AS x, generate_subscripts(list_filter(string_split(regexp_replace(t, '(?i)({word})', chr(1) || '\\1', 'g'), chr(1)), lambda x: starts_with(lower(x), lower('{word}'))), 1) AS i FROM s)"

    answer = r"(?is)^Error from server\s*\((\w+)\):\s*(.+)$"
    why, low = f"lower({_x('x', answer)})", "lower(m)"
    tips = f"CASE WHEN {why}='forbidden' AND contains({low},'quota') THEN 'Request increased quotas from cluster admin / Reduce resource requests in pod spec' WHEN {why}='forbidden' AND contains({low},'service account') THEN 'Create the service account / Check serviceAccountName in pod spec' WHEN {why}='forbidden' THEN 'Check RBAC permissions / Verify namespace exists and is accessible' WHEN {why}='invalid' AND contains({low},'resource') THEN 'Check resource requests/limits values / Ensure requests <= limits' WHEN {why}='invalid' THEN 'Validate YAML syntax / Check Kubernetes API version compatibility' WHEN {why}='conflict' THEN 'Fetch the latest version and reapply / Use server-side apply: kubectl apply --server-side' WHEN {why}='notfound' THEN 'Check if the resource exists / Verify the namespace is correct' ELSE '' END"
    server = f"SELECT {key}, 2, i, " + fields(_flat("m"), _x("m", obj), _x("m", obj, 2), _x("m", r'(?i)namespace\s+"?([^":\s]+)"?'), _x("x", answer), f"'kubernetes,kubectl,' || {why}", "'kubectl_apply'", tips=tips) + f" FROM (SELECT *, regexp_extract(x, {_q(answer)}, 2) AS m FROM {cut('Error from server')} WHERE {_m('x', answer)})"
    wrote = r'(?is)^error when (\w+)\s+"([^"]+)":\s*(.+)$'
    created = r'(?i)(\w+)\.(\w+/\w+)\s+"([^"]+)"'
    create = f"SELECT {key}, 3, i, " + fields(_flat("m"), f"split_part({_x('m', created, 2)}, '/', 1)", _x("m", created, 3), null, _x("m", r"(?i)is (\w+):"), f"'kubernetes,kubectl,' || lower({_x('x', wrote)})", "'kubectl_apply'", file=f"CASE WHEN contains({_x('x', wrote, 2)},'.yaml') OR contains({_x('x', wrote, 2)},'.yml') THEN {_x('x', wrote, 2)} END") + f" FROM (SELECT *, regexp_extract(x, {_q(wrote)}, 3) AS m FROM {cut('error when')} WHERE {_m('x', wrote)})"
    states = []
    for n, (state, (severity, advice)) in enumerate(K.POD_STATES.items(), 1):
        pod = f"coalesce({_x(t, rf'(?i)([a-z0-9][-a-z0-9]*)\s+\d+/\d+\s+{state}')}, {_x(t, r'Name:\s+(\S+)')})"
        event = _x(t, rf"(?i)((?:Warning|Error)\s+\w+\s+[^\n]*?{state}[^\n]*)")
        states.append(f"SELECT {key}, 4, {n}, " + fields(f"substr('Pod status: {state}' || coalesce(' - ' || {event}, ''), 1, 500)", "'Pod'", pod, _x(t, r"Namespace:\s+(\S+)"), f"'{state}'", f"'kubernetes,pod,{state.lower()}'", "'pod_status'", severity=f"'{severity}'", tips=_list(advice), pod=pod, container=either(t, r"(?i)Container:\s+(\S+)|container\s+(\S+)"), code_of_exit=f"TRY_CAST({_x(t, r'Exit Code:\s+(\d+)')} AS INT)", restarts=f"TRY_CAST({either(t, r'Restart Count:\s+(\d+)|RESTARTS\s+[^\n]*?(\d+)')} AS INT)") + f" FROM s WHERE contains(t, '{state}')")
    loose = r"(?s)(?:Error|error|ERROR)[:\s]+(.+?)(?:\n\n|$)"
    slashed = r"(?i)(pods?|deployments?|services?|statefulsets?|daemonsets?|jobs?|cronjobs?)/([^\s:]+)"
    generic = f"SELECT {key}, 5, 1, " + fields(_flat(_x(t, loose)), _x(t, slashed), _x(t, slashed, 2), either(t, space), null, "'kubernetes'", "'unknown'") + f" FROM s WHERE {_m(t, loose)} AND {key} NOT IN (SELECT {key} FROM k)"
    return f"WITH s AS (SELECT {key}, {text} AS t FROM {table} WHERE {where} AND {text} IS NOT NULL), k AS ({' UNION ALL '.join([helm, server, create, *states])}), g AS ({generic}), a AS (SELECT * FROM (SELECT * FROM k UNION ALL SELECT * FROM g) QUALIFY row_number() OVER (PARTITION BY {key}, coalesce(error_code,'None') || ':' || coalesce(resource_name,'None') || ':' || substr(error_message,1,50) ORDER BY part, i) = 1) SELECT *, CAST(row_number() OVER (PARTITION BY {key} ORDER BY part, i) AS INT) AS error_no FROM a"


_ID = "substr(sha256(coalesce({a},'')||chr(10)||coalesce(error_code,'')||chr(10)||coalesce(file,'')||chr(10)||regexp_replace(lower(substr(coalesce(error_message,''),1,160)), '^\\s+|\\s+$', '', 'g')),1,12)"
_ROUTED = f"(SELECT *, {_route('error_excerpt')} AS tool FROM pending_errors)"
_ALL = (
    f"SELECT seq, source, error_no, 'terraform' AS error_type, resource_type, resource_address, resource_name, error_code, file, line, cloud_provider, error_message, tags, {_ID.format(a='resource_address')} AS error_id FROM (SELECT x.*, r.tool AS source FROM ({_terraform(_ROUTED, 'seq', 'error_excerpt', 'tool IN (' + _q('terraform') + ', ' + _q('unknown') + ')')}) x JOIN {_ROUTED} r USING (seq))"
    f" UNION ALL SELECT seq, source, error_no, 'kubernetes', resource_type, NULL, resource_name, error_code, file, CAST(NULL AS INT), NULL, error_message, tags, {_ID.format(a='NULL')} FROM (SELECT x.*, r.tool AS source FROM ({_kubernetes(_ROUTED, 'seq', 'error_excerpt', 'tool <> ' + _q('terraform'))}) x JOIN {_ROUTED} r USING (seq))"
)
_FIRST = f"(SELECT * FROM ({_ALL}) QUALIFY row_number() OVER (PARTITION BY seq ORDER BY error_type <> 'terraform', error_no) = 1)"


def _short(length: int) -> str:
    return f"CASE WHEN coalesce(error_code,'')<>'' THEN error_code || ': ' || substr(error_message, 1, greatest(0, {length - 2} - length(error_code))) ELSE substr(error_message, 1, {length}) END"


def _merged(tail: str) -> str:
    """Tags of an error joined in order, spellings that differ in case once, as a query of seq and tags."""
    v = f"list_concat(string_split(tags, ','), [resource_type, nullif(cloud_provider,'unknown'), error_code, error_type]){tail}"
    return f"(SELECT seq, string_agg(t, ',' ORDER BY i) AS tags FROM (SELECT seq, arg_min(t, i) AS t, min(i) AS i FROM (SELECT seq, unnest({v}) AS t, generate_subscripts({v}, 1) AS i FROM f) WHERE t IS NOT NULL AND t <> '' GROUP BY seq, lower(t)) GROUP BY seq)"


SQL = {
    "source_route": f"SELECT doc_id, {_route('text')} AS tool FROM documents",
    "parsed_terraform": f"SELECT doc_id, {', '.join(_TF)}, tags, suggestions FROM ({_terraform('documents', 'doc_id', 'text')})",
    "parsed_kubernetes": f"SELECT doc_id, {', '.join(_K8S)}, tags, suggestions FROM ({_kubernetes('documents', 'doc_id', 'text')})",
    "parsed_errors": f"SELECT seq, source, error_no, error_type, resource_type, resource_address, resource_name, error_code, file, line, error_id FROM ({_ALL})",
    "parsed_counts": f"SELECT source, coalesce(cloud_provider,'-') AS provider, error_code, count(*) AS n FROM ({_ALL}) GROUP BY 1,2,3",
    "parsed_pending": f"WITH f AS {_FIRST} SELECT f.seq, error_type, {_short(120)} AS short_message, m.tags, nullif(concat_ws(':', file, CASE WHEN file IS NOT NULL THEN CAST(line AS VARCHAR) END), '') AS file, CASE WHEN coalesce(resource_address,'')='terraform.init' THEN 'terraform_init' WHEN regexp_matches(coalesce(resource_address,''),'^(variable|output|local|module)[.]') THEN 'terraform_config' ELSE 'resource' END AS kind FROM f JOIN {_merged('')} m USING (seq)",
    "parsed_fixes": f"WITH f AS (SELECT x.*, p.tags AS own FROM {_FIRST} x JOIN pending_errors p USING (seq)) SELECT f.seq, concat_ws(': ', coalesce(nullif(resource_address,''), nullif(resource_type,'') || '/' || nullif(resource_name,''), nullif(resource_type,'')), {_short(100)}) AS issue, m.tags FROM f JOIN {_merged(' || list_transform(string_split(coalesce(own,' + _q('') + '), ' + _q(',') + '), lambda t: trim(t))')} m USING (seq)",
}

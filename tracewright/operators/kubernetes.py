"""Typed error rows from kubectl and Helm output.

All that one text holds is an array of structs made in its row, so nothing is shuffled: a Helm error,
the API server's errors, errors of creating from files, and one for each pod status named. Only texts
with none of these get a generic row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.terraform import first_of_each, got, one_line

#: Pod states with their severity and what to try.
POD_STATES = {
    "ImagePullBackOff": ("error", ["Verify the image name and tag exist in the registry", "Check imagePullSecrets are configured correctly", "Ensure the registry is accessible from the cluster"]),
    "ErrImagePull": ("error", ["Check if the image exists in the registry", "Verify registry credentials in imagePullSecrets"]),
    "CrashLoopBackOff": ("critical", ["Check container logs: kubectl logs <pod-name>", "Verify environment variables and config", "Check if the application has proper health checks"]),
    "OOMKilled": ("critical", ["Increase memory limits in the pod spec", "Check for memory leaks in the application", "Review memory requests vs actual usage"]),
    "CreateContainerConfigError": ("error", ["Check if referenced ConfigMaps exist", "Check if referenced Secrets exist", "Verify volume mount configurations"]),
    "Pending": ("warning", ["Check node resources and scheduling constraints", "Verify PersistentVolumeClaims are bound", "Check node affinity and taints/tolerations"]),
    "FailedScheduling": ("error", ["Check node resources (CPU, memory)", "Verify node selectors and affinity rules", "Check for taints on nodes"]),
    "Unhealthy": ("warning", ["Check readiness/liveness probe configuration", "Verify the application endpoint is responding", "Review probe timeout and threshold settings"]),
}
#: What Helm failures say, with their code and what to try, in the order tried.
HELM_FAILURES = [
    ("cannot re-use a name", "ReleaseExists", ["Use 'helm upgrade' instead of 'helm install'", "Or use '--replace' flag to replace the existing release", "Or delete the existing release first: helm uninstall <release>"]),
    ("chart.*not found", "ChartNotFound", ["Run 'helm repo update' to refresh chart repositories", "Verify the chart name and repository"]),
    ("timed out waiting", "Timeout", ["Increase timeout with --timeout flag", "Check pod status for scheduling or image issues", "Review pod events for failure reasons"]),
    ("UPGRADE FAILED.*has no deployed releases", "NoDeployedReleases", ["Use 'helm install' for new releases", "Or use 'helm upgrade --install' to install if not present"]),
    ("failed pre-install|failed post-install", "HookFailed", ["Check hook job logs for failure details", "Verify hook resources have correct permissions"]),
    ("exceeded quota", "QuotaExceeded", ["Request increased quotas from cluster admin", "Reduce resource requests in values"]),
    ("RBAC|forbidden|cannot create", "RBACDenied", ["Check RBAC permissions for the service account", "Ensure ClusterRole/Role bindings are correct"]),
]
#: What Helm output looks like to the parser, and to the router (which looks for plain text).
HELM_SIGNS = [rf"(?i){p}" for p in (r"helm\s+(install|upgrade|rollback)", "INSTALLATION FAILED", "UPGRADE FAILED", "ROLLBACK FAILED", r"Error:\s+chart\s+", r'release\s+"[^"]+"\s+')]
HELM_WORDS = ["helm install", "helm upgrade", "helm rollback", "installation failed", "upgrade failed", "rollback failed", "helm template", 'release "']
#: What kubectl output looks like.
KUBERNETES_SIGNS = [
    rf"(?i){p}"
    for p in (
        r"kubectl\s+(apply|create|delete|get|describe)", r"helm\s+(install|upgrade|rollback|template)", "Error from server", "error when creating", "INSTALLATION FAILED", "UPGRADE FAILED", "ImagePullBackOff",
        "CrashLoopBackOff", "OOMKilled", "CreateContainerConfigError", "FailedScheduling", r"pod/[a-z0-9-]+", r"deployment\.apps/", "service/", r"namespace:.*\s+\w+", r"kubectl.*-n\s+\w+", r"\.yaml.*error",
    )
]
#: Patterns of objects and namespaces.
UNDERLYING = r'(?i)(pods?|deployments?|services?|configmaps?|secrets?)\s+"?([^":\s]+)"?\s+is\s+(\w+)'
OBJECT = r'(?i)(pods?|deployments?|services?|configmaps?|secrets?|statefulsets?)\s+"?([^":\s]+)"?'
CREATED = r'(?i)(\w+)\.(\w+/\w+)\s+"([^"]+)"'
SLASHED = r"(?i)(pods?|deployments?|services?|statefulsets?|daemonsets?|jobs?|cronjobs?)/([^\s:]+)"
NAMESPACE = r"(?i)-n\s+(\S+)|namespace[=:\s]+(\S+)"

_FIELDS = {
    "error_message": "string", "resource_type": "string", "resource_name": "string", "namespace": "string", "file": "string", "error_code": "string", "severity": "string", "suggestions": "array<string>",
    "tags": "array<string>", "k8s_error_type": "string", "pod_name": "string", "container_name": "string", "exit_code": "int", "restart_count": "int", "helm_release": "string", "helm_chart": "string",
}


def _error(**fields: Column) -> Column:
    """An error's struct; fields that are not given are null (severity: error)."""
    fields = {"severity": F.lit("error"), "suggestions": F.array().cast("array<string>"), **fields}
    return F.struct(*[fields.get(k, F.lit(None)).cast(t).alias(k) for k, t in _FIELDS.items()])


def _texts(*values: str) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _either(text: Column, pattern: str) -> Column:
    return F.coalesce(got(text, pattern, 1), got(text, pattern, 2))


def _any(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, c: a | c, [text.rlike(p) for p in patterns])


def says_helm(text: Column) -> Column:
    """Whether the router takes a text for Helm output."""
    low = F.lower(text)
    return reduce(lambda a, c: a | c, [low.contains(w) for w in HELM_WORDS])


def says_kubernetes(text: Column) -> Column:
    """Whether a text looks like kubectl output."""
    return _any(text, KUBERNETES_SIGNS)


def helm_errors(text: Column) -> Column:
    """The Helm error of a text as an array of one; empty for other texts."""
    kind = F.when(text.contains("INSTALLATION FAILED"), "helm_install").when(text.contains("UPGRADE FAILED"), "helm_upgrade").otherwise("unknown")
    said = F.coalesce(got(text, r"(?s)Error:\s*(.+?)(?:\n\n|\n[A-Z]|\z)"), F.lit("Helm operation failed"))
    release = got(text, r'(?i)release\s+"([^"]+)"')
    pick = lambda i: [F.when(text.rlike(f"(?i){f[0]}"), F.lit(f[1]) if i == 1 else _texts(*f[2])) for f in HELM_FAILURES]
    error = _error(
        error_message=one_line(said),
        resource_type=F.coalesce(F.lower(got(text, UNDERLYING, 1)), F.lit("helm_release")),
        resource_name=F.coalesce(got(text, UNDERLYING, 2), release),
        namespace=_either(text, NAMESPACE),
        error_code=F.coalesce(*pick(1)),
        suggestions=F.coalesce(*pick(2), _texts()),
        tags=F.array(F.lit("kubernetes"), F.lit("helm"), kind),
        k8s_error_type=kind,
        helm_release=release,
        helm_chart=got(text, r'(?i)chart\s+"([^"]+)"'),
    )
    return F.when(_any(text, HELM_SIGNS), F.array(error)).otherwise(F.slice(F.array(error), 1, 0))


def server_advice(reason: Column, said: Column) -> Column:
    """What to try after an answer of the API server."""
    low, why = F.lower(said), F.lower(reason)
    return (
        F.when((why == "forbidden") & low.contains("quota"), _texts("Request increased quotas from cluster admin", "Reduce resource requests in pod spec"))
        .when((why == "forbidden") & low.contains("service account"), _texts("Create the service account", "Check serviceAccountName in pod spec"))
        .when(why == "forbidden", _texts("Check RBAC permissions", "Verify namespace exists and is accessible"))
        .when((why == "invalid") & low.contains("resource"), _texts("Check resource requests/limits values", "Ensure requests <= limits"))
        .when(why == "invalid", _texts("Validate YAML syntax", "Check Kubernetes API version compatibility"))
        .when(why == "conflict", _texts("Fetch the latest version and reapply", "Use server-side apply: kubectl apply --server-side"))
        .when(why == "notfound", _texts("Check if the resource exists", "Verify the namespace is correct"))
        .otherwise(_texts())
    )


def server_errors(text: Column) -> Column:
    """The API server's errors of a text, in order."""
    pattern = r"(?is)^Error from server\s*\((\w+)\):\s*(.+)\z"
    parts = F.filter(F.split(text, "(?i)(?=Error from server)"), lambda p: p.rlike(pattern))

    def error(p: Column) -> Column:
        reason, said = F.regexp_extract(p, pattern, 1), F.regexp_extract(p, pattern, 2)
        return _error(
            error_message=one_line(said), resource_type=got(said, OBJECT, 1), resource_name=got(said, OBJECT, 2), namespace=got(said, r'(?i)namespace\s+"?([^":\s]+)"?'), error_code=reason,
            suggestions=server_advice(reason, said), tags=F.array(F.lit("kubernetes"), F.lit("kubectl"), F.lower(reason)), k8s_error_type=F.lit("kubectl_apply"),
        )

    return F.transform(parts, error)


def create_errors(text: Column) -> Column:
    """The errors of creating objects from files, in order."""
    pattern = r'(?is)^error when (\w+)\s+"([^"]+)":\s*(.+)\z'
    parts = F.filter(F.split(text, "(?i)(?=error when)"), lambda p: p.rlike(pattern))

    def error(p: Column) -> Column:
        what, said = F.regexp_extract(p, pattern, 2), F.regexp_extract(p, pattern, 3)
        return _error(
            error_message=one_line(said), resource_type=F.substring_index(got(said, CREATED, 2), "/", 1), resource_name=got(said, CREATED, 3), file=F.when(what.rlike(r"\.ya?ml"), what),
            error_code=got(said, r"(?i)is (\w+):"), tags=F.array(F.lit("kubernetes"), F.lit("kubectl"), F.lower(F.regexp_extract(p, pattern, 1))), k8s_error_type=F.lit("kubectl_apply"),
        )

    return F.transform(parts, error)


def state_errors(text: Column) -> Column:
    """An error for each pod state that a text names."""
    common = {
        "namespace": got(text, r"Namespace:\s+(\S+)"),
        "container_name": _either(text, r"(?i)Container:\s+(\S+)|container\s+(\S+)"),
        "exit_code": got(text, r"Exit Code:\s+(\d+)"),
        "restart_count": _either(text, r"Restart Count:\s+(\d+)|RESTARTS\s+[^\n]*?(\d+)"),
        "resource_type": F.lit("Pod"),
        "k8s_error_type": F.lit("pod_status"),
    }
    errors = []
    for state, (severity, tips) in POD_STATES.items():
        pod = F.coalesce(got(text, rf"(?i)([a-z0-9][-a-z0-9]*)\s+\d+/\d+\s+{state}"), got(text, r"Name:\s+(\S+)"))
        event = got(text, rf"(?i)((?:Warning|Error)\s+\w+\s+[^\n]*?{state}[^\n]*)")
        said = F.substring(F.concat(F.lit(f"Pod status: {state}"), F.coalesce(F.concat(F.lit(" - "), event), F.lit(""))), 1, 500)
        error = _error(error_message=said, resource_name=pod, pod_name=pod, error_code=F.lit(state), severity=F.lit(severity), suggestions=_texts(*tips), tags=_texts("kubernetes", "pod", state.lower()), **common)
        errors.append(F.when(text.contains(state), error))
    return F.array_compact(F.array(*errors))


def generic_errors(text: Column) -> Column:
    """What a text without any known form says after the word error, as an array of one; empty without it."""
    pattern = r"(?s)(?:Error|error|ERROR)[:\s]+(.+?)(?:\n\n|\z)"
    error = _error(error_message=one_line(got(text, pattern)), resource_type=got(text, SLASHED, 1), resource_name=got(text, SLASHED, 2), namespace=_either(text, NAMESPACE), tags=_texts("kubernetes"), k8s_error_type=F.lit("unknown"))
    return F.when(text.rlike(pattern), F.array(error)).otherwise(F.slice(F.array(error), 1, 0))


def parse_kubernetes(df: DataFrame, text: str) -> DataFrame:
    """The error rows of kubectl and Helm outputs: the other columns of ``df``, ``error_no`` (from 1) and an error's fields.

    Of errors with the same code, name and start of the message the first counts. Null texts and texts
    without an error have no rows; a column of ``df`` named like a field is replaced.
    """
    t = F.col(text)
    text_of = lambda c: F.coalesce(c, F.lit("None"))
    key = lambda e: F.concat_ws(":", text_of(e["error_code"]), text_of(e["resource_name"]), F.substring(e["error_message"], 1, 50))
    keep = [c for c in df.columns if c != text and c not in _FIELDS and c not in ("error_no", "error_type", "raw_output")]
    known = df.select(*keep, t.alias("__text"), F.concat(helm_errors(t), server_errors(t), create_errors(t), state_errors(t)).alias("__e"))
    known = known.withColumn("__e", F.when(F.size("__e") > 0, first_of_each(F.col("__e"), key)).otherwise(generic_errors(F.col("__text"))))
    rows = known.select(*keep, "__text", F.posexplode("__e").alias("__at", "__e"))
    return rows.select(*keep, (F.col("__at") + 1).cast("int").alias("error_no"), F.lit("kubernetes").alias("error_type"), F.col("__text").alias("raw_output"), "__e.*")

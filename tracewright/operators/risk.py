"""The risk of plans: what a change reaches, which past fixes matter, a score from 0 to 100, and why.

Everything is set-oriented: one job scores any number of plans. ``nodes`` are the changing resources
(``plan.nodes``), ``key`` is the column that tells a plan. Per plan there is one row of ``facts``,
made in one aggregation; nodes are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.functions.fields import base_address, comma_tags, module_path
from tracewright.functions.text import instant_us
from tracewright.operators.graph import propagate
from tracewright.operators.plan import attribute_category, control_point
from tracewright.operators.search import anchor, anchors, cluster_key, needles_in, starts_in
from tracewright.sources.scratch import settle

#: Points of an action; factors; limits.
POINTS = {"create": 8, "delete": 20, "replace": 25, "update": 5}
BOUNDARY, NEW_BOUNDARY, NEW_OTHER = "1.5", "0.5", "0.3"
IMPACT, IMPACT_NEW, IMPACT_PLAIN = "1.5", "0.375", "0.5"
MOST_IMPACTED, MOST_HISTORY, HISTORY_POINTS, NEW_CEILING, WILDCARD_FLOOR = 25, 15, 5, 45, 50
#: Severities from the score they begin at.
SEVERITIES = [("critical", 75), ("high", 50), ("medium", 25), ("low", 0)]
DEPTH = 5
#: What to look at when an attribute of a type changes, by category, and on deletion.
ATTRIBUTE_CHECKS = {
    ("aws_security_group", "ingress"): "Review new ingress rules for overly permissive CIDRs (0.0.0.0/0)",
    ("aws_security_group", "egress"): "Review egress rules for least-privilege outbound access",
    ("aws_iam_role", "assume_role_policy"): "Audit trust policy principals for wildcard or cross-account access",
    ("aws_iam_role_policy", "policy"): "Review inline policy for least-privilege",
    ("aws_iam_policy", "policy"): "Review managed policy document for overly broad permissions",
    ("aws_instance", "instance_type"): "Verify instance type availability in target AZ and region",
    ("aws_instance", "ami"): "Confirm AMI exists and is shared to this account",
    ("aws_db_instance", "engine_version"): "Check RDS engine version compatibility and upgrade path",
    ("aws_s3_bucket", "acl"): "Review bucket ACL — prefer bucket policies over ACLs",
    ("aws_lambda_function", "runtime"): "Verify runtime is not deprecated",
    ("aws_vpc", "cidr_block"): "CIDR change forces replacement — verify peering/route table dependencies",
    ("aws_subnet", "cidr_block"): "Subnet CIDR change forces replacement — check ENI dependencies",
}
CATEGORY_CHECKS = {
    "iam": ["Review IAM policy least-privilege before applying", "Check service account permissions"],
    "rbac": ["Review RBAC role assignment scope", "Verify key vault access policy changes"],
    "network": ["Verify security group rules", "Check for open 0.0.0.0/0 rules"],
}
DELETE_CHECK = "Confirm resource is not referenced by other stacks"
#: Tags that tell a fix's concern; words that are no codes; resolutions that say nothing.
CONCERNS = """networking network rbac iam dns quota state state-lock auth authentication authorization acl route routing connectivity ingress
egress security firewall k8s kubernetes key_vault vault certificate cert database db storage permissions""".split()
NO_CODES = ["error", "failed", "true", "false"]
SAYS_NOTHING = ["fixed it", "fixed", "resolved"]
CODE = "(?i)(?:api error |error:\\s*|code[:\\s]*[\"']?)(\\w+(?:\\.\\w+)*)"
#: Signals of relevance with their score, highest first.
SIGNALS = {"error_code": 150, "address": 120, "attribute": 100, "category": 80, "type_action": 60, "resource_type_tag": 40, "resource_type_text": 20}
MODULE_BONUS, RECENT_BONUS, RECENT_DAYS = 20, 30, 90
_DEC = "decimal(12,4)"


def _dec(x: str | int) -> Column:
    return F.lit(str(x)).cast(_DEC)


def is_boundary(kind: Column) -> Column:
    """Whether a type controls access or traffic."""
    return control_point(kind).isNotNull()


# --- what a change reaches -------------------------------------------------------------------


def extra_seeds(nodes: DataFrame, edges: DataFrame, key: str, providers: bool = False) -> DataFrame:
    """key, node: what control points depend on directly and the plan does not change. ``providers``: also provider nodes."""
    cp = nodes.where("is_control_point").select(key, F.col("address").alias("src"))
    deps = edges.join(cp, [key, "src"], "left_semi").select(key, F.col("dst").alias("node")).distinct()
    deps = deps if providers else deps.where(~F.col("node").startswith("provider["))
    return deps.join(nodes.select(key, F.col("address").alias("node")), [key, "node"], "left_anti")


def affected(nodes: DataFrame, edges: DataFrame, key: str, depth: int = DEPTH, providers: bool = False) -> DataFrame:
    """key, node, depth, path: what depends on a plan's changes and is not changed itself.

    ``edges``: key, src, dst (src depends on dst). From the changed resources and ``extra_seeds`` against
    the edges; beyond the first level only in plans that change a control point or destroy something.
    """
    starts = nodes.select(key, F.col("address").alias("node")).unionByName(extra_seeds(nodes, edges, key, providers))
    deep = nodes.groupBy(key).agg(F.bool_or(F.col("is_control_point") | F.col("action").isin("delete", "replace")).alias("deep"))
    found = propagate(edges, starts, depth, key)
    inside = nodes.select(key, F.explode(F.array_distinct(F.array("address", base_address(F.col("address"))))).alias("node"))
    kept = found.join(inside, [key, "node"], "left_anti").join(deep, key)
    return kept.where("depth = 1 or deep").drop("deep")


def why_paths(reached: DataFrame, key: str, most: int = 20) -> DataFrame:
    """The first paths of each plan, nearest first: key, place, target, depth, path."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("depth", "node"))
    return reached.withColumn("place", place).where(F.col("place") <= most).select(key, "place", F.col("node").alias("target"), "depth", "path")


# --- which fixes matter ----------------------------------------------------------------------


def leaf_pair(address: Column) -> Column:
    """The last two parts of an address; more where the first of them would be a module."""
    parts = F.split(address, r"\.")
    n = F.size(parts)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: ~F.get(parts, i).startswith("module"))
    return F.when((n >= 2) & (F.size(starts) > 0), F.array_join(F.slice(parts, F.array_max(starts) + 1, n), ".")).otherwise(address)


def _prepared(fixes: DataFrame, now_us: int) -> DataFrame:
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    text = F.lower(F.concat_ws(" ", filled("issue"), filled("resolution"), filled("error_excerpt")))
    age = F.floor((F.lit(now_us) - instant_us(F.col("created_at"))) / 86_400_000_000)
    codes = F.filter(F.regexp_extract_all("t", F.lit(CODE), F.lit(1)), lambda c: (F.length(c) > 3) & ~c.isin(NO_CODES))
    rows = fixes.withColumn("t", text).withColumn("tag_list", comma_tags(F.col("tags"))).withColumn("words", F.array_distinct(F.regexp_extract_all("t", F.lit(r"\w+"), F.lit(0))))
    return rows.withColumn("code", F.array_max(F.transform(codes, lambda c: F.struct(F.length(c).alias("n"), c.alias("c"))))["c"]).withColumn("recent", F.coalesce(age < RECENT_DAYS, F.lit(False)))


def _parts(nodes: DataFrame, key: str) -> DataFrame:
    """What of a node can meet a fix: its type (rt), address without index (whole), the address's end (leaf) and its module (mod)."""
    path = F.lower(F.nullif(module_path(F.concat(F.col("address"), F.lit("."))), F.lit("")))
    return nodes.select(key, "ord", "address", "action", "changed_attrs", "attr_categories", F.lower(F.trim("resource_type")).alias("rt"), F.lower(base_address(F.col("address"))).alias("whole"), F.lower(leaf_pair(F.col("address"))).alias("leaf"), path.alias("mod"))


def _with_signals(pairs: DataFrame) -> DataFrame:
    """Pairs of a node (``_parts``) and a fix (``_prepared``) that have anything in common, with base, signal, supporting and total."""
    has_tag = F.array_contains("tag_list", F.col("rt"))
    in_text = F.array_contains("words", F.col("rt"))
    typed = (has_tag | in_text) & (F.col("rt") != "")
    named = F.col("t").contains(F.col("whole")) | F.col("t").contains(F.col("leaf"))
    holds = {
        "error_code": typed & F.col("code").isNotNull(),
        "address": named,
        "attribute": typed & F.arrays_overlap("changed_attrs", "words"),
        "category": typed & F.arrays_overlap("attr_categories", "tag_list"),
        "type_action": has_tag & F.col("t").contains(F.col("action")),
        "resource_type_tag": has_tag & (F.col("rt") != ""),
        "resource_type_text": in_text & (F.col("rt") != ""),
    }
    yes = {s: F.coalesce(c, F.lit(False)) for s, c in holds.items()}
    signal = F.coalesce(*[F.when(c, F.lit(s)) for s, c in yes.items()])
    base = F.coalesce(*[F.when(yes[s], F.lit(p)) for s, p in SIGNALS.items()])
    module = F.coalesce(F.col("t").contains(F.col("mod")), F.lit(False))
    lesser = [F.when(yes[s] & (F.col("base") > SIGNALS[s]), F.lit(s)) for s in ("attribute", "category", "type_action")]
    met = pairs.where(F.coalesce(typed, F.lit(False)) | (F.col("address").contains(".") & named))
    scored = met.withColumn("signal", signal).withColumn("base", base).where("signal is not null").withColumn("__module", module)
    supporting = F.array_compact(F.array(*lesser, F.when(F.col("__module"), "module_path"), F.when(F.col("recent"), "recency")))
    total = F.col("base") + F.when(F.col("__module"), MODULE_BONUS).otherwise(0) + F.when(F.col("recent"), RECENT_BONUS).otherwise(0)
    return scored.withColumns({"supporting": supporting, "total": total}).drop("__module")


def _best(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """The first fixes (seq, total, at) of each group: best, then longer creation times, then earlier ones, then storage order."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("total"), F.desc(F.length("at")), "at", "seq"))
    return rows.withColumn("place", place).where(F.col("place") <= most)


def _likely(n: DataFrame, f: DataFrame, key: str, most: int) -> DataFrame:
    """key, seq, total, place: the ``most`` best fixes of each plan, whose nodes are ``n`` (``_parts``); ``f`` is ``_prepared``.

    No pair of a node and a fix is made. A pair's score is the highest that one thing in common gives: a type,
    a type with an action, an attribute or a category, or an address. For each such thing of any node the ``most`` best of its
    fixes are kept, alone and with each module they name. A fix that is not kept there has that many better ones in
    every plan that has this thing, so the best of a plan are among those kept.
    """
    none = F.lit("")
    odd = (F.col("rt") != "") & (anchor(F.col("whole")).isNull() | anchor(F.col("leaf")).isNull())
    modules, oddities = n.agg(F.bool_or(F.col("mod").isNotNull()), F.bool_or(odd)).first()
    slim = f.select("seq", "at", F.when(F.col("recent"), RECENT_BONUS).otherwise(0).alias("bonus"))
    places = needles_in(n.where("mod is not null").select(F.col("mod").alias("needle")), f.select("seq", "t")).withColumnRenamed("needle", "mod") if modules else None

    def kept(rows: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
        """``most`` rows of each key without module (mod ''), and of each key and module that ``keys`` has."""
        every = rows.withColumn("mod", none)
        if places is not None:
            inside = rows.join(places, "seq").join(keys.where("mod <> ''").select(*by, "mod").distinct(), [*by, "mod"])
            every = every.unionByName(inside.withColumn("total", F.col("total") + MODULE_BONUS))
        return settle(_best(every, [*by, "mod"], most).select(*by, "mod", "seq", "total", "at"), "kept")

    def ways(rows: DataFrame) -> DataFrame:
        """Rows for the key alone and for the key with its module."""
        return rows.withColumn("mod", F.explode(F.array_distinct(F.array(none, F.col("mod"))))) if places is not None else rows.withColumn("mod", none)

    # By type, and what goes with a type: for each different kind of node.
    kind = ["rt", "action", "changed_attrs", "attr_categories", "in_module"]
    nodes = n.withColumn("in_module", F.coalesce("mod", none))
    kinds = settle(nodes.where("rt <> ''").select(*kind).distinct(), "kinds")
    thing = lambda what, value: F.struct(F.lit(what).alias("what"), value.alias("value"))
    things = F.concat(F.array(thing("type", none), thing("type_action", F.col("action"))), F.transform("changed_attrs", lambda a: thing("attribute", a)), F.transform("attr_categories", lambda c: thing("category", c)))
    asked = kinds.select(*kind, F.col("in_module").alias("mod"), F.explode(things).alias("k")).select(*kind, "mod", "k.what", "k.value")
    tokens = f.select("seq", F.explode(F.array_union("words", "tag_list")).alias("rt"))
    typed = tokens.join(asked.groupBy("rt").agg(F.collect_set(F.struct("what", "value")).alias("things")), "rt").join(f, "seq")
    tagged = F.array_contains("tag_list", F.col("rt"))

    def holds(k: Column) -> Column:
        what, value = k["what"], k["value"]
        return F.when(what == "type", True).when(what == "type_action", tagged & F.col("t").contains(value)).when(what == "attribute", F.array_contains("words", value)).otherwise(F.array_contains("tag_list", value))

    score = F.when((F.col("k.what") == "type") & F.col("code").isNotNull(), SIGNALS["error_code"]).when((F.col("k.what") == "type") & tagged, SIGNALS["resource_type_tag"]).when(F.col("k.what") == "type", SIGNALS["resource_type_text"])
    score = F.coalesce(score, *[F.when(F.col("k.what") == s, SIGNALS[s]) for s in ("type_action", "attribute", "category")])
    entries = typed.withColumn("k", F.explode(F.filter("things", holds))).select("rt", "k.what", "k.value", "seq", score.alias("base")).join(slim, "seq")
    entries = entries.select("rt", "what", "value", "seq", (F.col("base") + F.col("bonus")).alias("total"), "at")
    by_thing = kept(settle(entries, "entries") if modules else entries, asked, ["rt", "what", "value"])
    of_kind = ways(asked).join(by_thing, ["rt", "what", "value", "mod"]).groupBy(*kind, "seq").agg(F.max("total").alias("total"), F.any_value("at").alias("at"))
    of_kind = settle(_best(of_kind, kind, most).select(*kind, "seq", "total", "at"), "of-kind")
    found = nodes.where("rt <> ''").select(key, *kind).distinct().join(of_kind, kind).select(key, "seq", "total", "at")

    # By address.
    ends = lambda rows, *more: rows.select(*more, F.explode(F.array_distinct(F.array("whole", "leaf"))).alias("needle"), F.col("in_module").alias("mod"))
    dotted = ends(nodes.where(F.col("address").contains(".")), key)
    hits = needles_in(dotted.select("needle"), f.select("seq", "t")).join(slim, "seq").select("needle", "seq", (F.lit(SIGNALS["address"]) + F.col("bonus")).alias("total"), "at")
    by_end = kept(settle(hits, "hits") if modules else hits, dotted, ["needle"])
    found = found.unionByName(ways(dotted).distinct().join(by_end, ["needle", "mod"]).select(key, "seq", "total", "at"))
    if oddities:  # addresses without a dot between others: looked for in the fixes of their type
        bare = ends(nodes.where(odd), key, "rt")
        within = bare.select("rt", "needle").distinct().join(tokens, "rt").join(f.select("seq", "t"), "seq").where(F.col("t").contains(F.col("needle")))
        hits = settle(within.join(slim, "seq").select("rt", "needle", "seq", (F.lit(SIGNALS["address"]) + F.col("bonus")).alias("total"), "at"), "hits")
        found = found.unionByName(ways(bare).distinct().join(kept(hits, bare, ["rt", "needle"]), ["rt", "needle", "mod"]).select(key, "seq", "total", "at"))
    return _best(found.groupBy(key, "seq").agg(F.max("total").alias("total"), F.any_value("at").alias("at")), [key], most).select(key, "seq", "total", "place")


def relevant_fixes(nodes: DataFrame, fixes: DataFrame, key: str, now_us: int, most: int = 10) -> DataFrame:
    """The fixes that matter most to each plan: key, place, seq, score, signal, supporting, confidence, matched, resource.

    ``fixes``: seq, issue, resolution, error_excerpt, tags, created_at; one row a fix. A fix counts by its best
    node (the first of equals). Order: score, then longer creation times, then earlier ones, then storage
    order. ``matched``: how many resources it matches; ``resource``: the first by address. An address without a dot
    meets no text. Read ``nodes`` from a table, as it is scanned several times.
    """
    f = settle(_prepared(fixes, now_us).select("seq", "t", "tag_list", "words", "code", "recent", F.coalesce("created_at", F.lit("")).alias("at")), "prepared")
    n = _parts(nodes, key)
    top = settle(_likely(n, f, key, most), "likely")
    few = settle(f.join(top.select("seq").distinct(), "seq", "left_semi"), "few")
    signals = _with_signals(top.select(key, "seq", "place").join(n, key).join(few, "seq"))
    best = F.max_by(F.struct("signal", "supporting", "total"), F.struct("total", -F.col("ord")))
    each = signals.groupBy(key, "seq").agg(F.any_value("place").alias("place"), best.alias("b"), F.count(F.lit(1)).alias("matched"), F.min("address").alias("resource"))
    confidence = F.when(F.col("b.total") >= 120, "high").when(F.col("b.total") >= 60, "medium").otherwise("low")
    return each.select(key, "place", "seq", F.col("b.total").alias("score"), "b.signal", "b.supporting", confidence.alias("confidence"), "matched", "resource")


def qualifying(relevant: DataFrame, key: str) -> DataFrame:
    """key, history: how many of a plan's relevant fixes count for its score, 3 at most."""
    counts = (F.col("confidence") == "high") | ((F.col("confidence") == "medium") & (F.size("supporting") > 0))
    return relevant.where(counts).groupBy(key).agg(F.least(F.count(F.lit(1)), F.lit(3)).cast("int").alias("history"))


# --- score -----------------------------------------------------------------------------------


def _points(action: Column) -> Column:
    return F.coalesce(*[F.when(action == a, _dec(p)) for a, p in POINTS.items()], _dec(0))


def facts(nodes: DataFrame, key: str, reached: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """One row a plan: changes, flags, summed points, and counts of what is reached (l1, l2) and of history."""
    action = F.col("action")
    boundary = F.col("is_control_point")
    plain = F.when(boundary, _points(action) * _dec(BOUNDARY)).otherwise(_points(action))
    new = F.when(boundary, plain * _dec(NEW_BOUNDARY)).otherwise(plain * _dec(NEW_OTHER))
    out = nodes.groupBy(key).agg(
        F.count(F.lit(1)).alias("changes"),
        F.count(F.when(boundary, 1)).alias("control_points"),
        F.bool_and(action == "create").alias("greenfield"),
        F.bool_and((action == "update") & ~boundary).alias("plain_updates"),
        F.bool_or(boundary).alias("has_boundary"),
        F.bool_or(action.isin("delete", "replace")).alias("has_destructive"),
        F.bool_or("wildcard_trust").alias("wildcard"),
        F.sum(plain.cast(_DEC)).alias("__plain"),
        F.sum(new.cast(_DEC)).alias("__new"),
        F.sum(F.col("sensitivity_delta").cast(_DEC)).alias("__delta"),
    )
    out = out.withColumn("points", (F.when(F.col("greenfield"), F.col("__new")).otherwise(F.col("__plain")) + F.col("__delta")).cast("decimal(20,4)")).drop("__plain", "__new", "__delta")
    if reached is not None:
        out = out.join(reached.groupBy(key).agg(F.count(F.when(F.col("depth") == 1, 1)).alias("l1"), F.count(F.when(F.col("depth") > 1, 1)).alias("l2")), key, "left")
    else:
        out = out.withColumns({"l1": F.lit(0), "l2": F.lit(0)})
    out = out.join(history, key, "left") if history is not None else out.withColumn("history", F.lit(0))
    return out.fillna(0, ["l1", "l2", "history"])


def _impact() -> tuple[Column, Column]:
    impacted = F.least(F.col("l1") + F.col("l2"), F.lit(MOST_IMPACTED))
    factor = F.when(F.col("greenfield"), _dec(IMPACT_NEW)).when(F.col("plain_updates"), _dec(IMPACT_PLAIN)).otherwise(_dec(IMPACT))
    return impacted, (impacted.cast(_DEC) * factor).cast(_DEC)


def scored(f: DataFrame) -> DataFrame:
    """``facts`` with score (rounded half to even, one digit) and severity."""
    raw = F.col("points") + _impact()[1] + F.least(F.col("history") * HISTORY_POINTS, F.lit(MOST_HISTORY)).cast(_DEC)
    capped = F.when(F.col("greenfield") & (F.col("l1") + F.col("l2") == 0), F.least(raw, _dec(NEW_CEILING))).otherwise(raw)
    floored = F.when(F.col("wildcard"), F.greatest(capped, _dec(WILDCARD_FLOOR))).otherwise(capped)
    score = F.bround(F.least(_dec(100), F.greatest(_dec(0), floored)), 1).cast("decimal(5,1)")
    return f.withColumn("score", score).withColumn("severity", severity(F.col("score")))


def severity(score: Column) -> Column:
    """The severity of a score."""
    return F.coalesce(*[F.when(score >= at, F.lit(name)) for name, at in SEVERITIES])


def at_least(name: Column, threshold: str) -> Column:
    """Whether a severity reaches a threshold."""
    order = [s for s, _ in SEVERITIES]
    return name.isin(order[: order.index(threshold) + 1])


def explanations(nodes: DataFrame, f: DataFrame, key: str) -> DataFrame:
    """key, ord, sub, label, delta, kind: what the score is made of, in the order (ord, sub)."""
    n = nodes.join(f.select(key, "greenfield"), key)
    pts = _points(F.col("action"))
    worth = F.when(F.col("is_control_point"), pts * _dec(BOUNDARY) * F.when(F.col("greenfield"), _dec(NEW_BOUNDARY)).otherwise(_dec(1))).otherwise(pts * F.when(F.col("greenfield"), _dec(NEW_OTHER)).otherwise(_dec(1)))
    marks = F.concat_ws(", ", F.when(F.col("is_control_point"), "boundary resource"), F.when(F.col("greenfield"), "greenfield"))
    reason = F.col("sensitivity_reason")
    iam = F.when((reason != "") & (reason != "policy field changed"), F.concat(F.lit("IAM trust expanded on "), F.col("address"), F.lit(": "), reason)).otherwise(F.concat(F.lit("IAM policy field changed on "), F.col("address")))
    bullet = lambda sub, label, delta, kind: F.struct(F.lit(sub).alias("sub"), label.alias("label"), F.bround(delta, 1).cast("decimal(12,1)").alias("delta"), F.lit(kind).alias("kind"))
    own = F.array_compact(
        F.array(
            F.when(worth > 0, bullet(0, F.concat(F.col("action"), F.lit(" "), F.col("address"), F.when(marks != "", F.concat(F.lit(" ("), marks, F.lit(")"))).otherwise("")), worth, "action")),
            F.when(F.col("sensitivity_delta") > 0, bullet(1, iam, F.col("sensitivity_delta").cast(_DEC), "iam")),
            F.when(F.col("wildcard_trust"), bullet(2, F.lit("Wildcard principal (*) in IAM trust policy — forces minimum HIGH score"), _dec(0), "modifier")),
        )
    )
    impacted, gain = _impact()
    past = F.least(F.col("history") * HISTORY_POINTS, F.lit(MOST_HISTORY))
    many = lambda one, more: F.when(F.col("history") > 1, more).otherwise(one)
    history = F.concat(F.lit("Prior similar incident"), many("", "s"), F.lit(" detected in fix history ("), F.col("history").cast("string"), F.lit(" match"), many("", "es"), F.lit(")"))
    whole = F.array_compact(
        F.array(
            F.when(impacted > 0, bullet(0, F.concat(impacted.cast("string"), F.lit(" downstream resource(s) affected via dependency graph")), gain, "impact")),
            F.when(F.col("history") > 0, bullet(1, history, past.cast(_DEC), "history")),
            F.when(F.col("greenfield") & (F.col("l1") + F.col("l2") == 0), bullet(2, F.lit("Greenfield plan (all creates, no cross-boundary impact) — capped at MEDIUM"), _dec(0), "modifier")),
        )
    )
    return n.select(key, "ord", F.inline(own)).unionByName(f.select(key, F.lit(2**31 - 1).alias("ord"), F.inline(whole)))


# --- what to check ---------------------------------------------------------------------------


def checks(nodes: DataFrame, relevant: DataFrame | None, fixes: DataFrame | None, key: str) -> DataFrame:
    """key, step, ord, sub, check, source, resource: what to check, each text once a plan, in the order (step, ord, sub)."""
    rt = F.lower(F.trim("resource_type"))
    attrs = nodes.select(key, "ord", "address", rt.alias("rt"), F.posexplode("changed_attrs").alias("sub", "attr"))
    text = F.coalesce(*[F.when((F.col("rt") == t) & (F.col("attr") == a), F.lit(c)) for (t, a), c in ATTRIBUTE_CHECKS.items()])
    one = attrs.withColumn("check", text).where("check is not null")
    firsts = one.groupBy(key, "check").agg(F.min(F.struct("ord", "sub", "address")).alias("m"))
    out = firsts.select(key, F.lit(1).alias("step"), "m.ord", "m.sub", "check", F.lit("attribute").alias("source"), F.col("m.address").alias("resource"))
    if relevant is not None and fixes is not None:
        res = F.col("resolution")
        told = relevant.where("confidence = 'high'").join(fixes.select("seq", "resolution"), "seq")
        told = told.where((F.length(res) >= 20) & ~F.lower(F.trim(res)).isin(SAYS_NOTHING)).withColumn("check", F.concat(F.lit("Prior fix: "), F.left(res, F.lit(80))))
        told = told.groupBy(key, "check").agg(F.min(F.struct("place", "resource")).alias("m"))
        turn = F.row_number().over(Window.partitionBy(key).orderBy("m.place"))
        out = out.unionByName(told.withColumn("turn", turn).where("turn <= 2").select(key, F.lit(2).alias("step"), F.col("m.place").alias("ord"), F.lit(0).alias("sub"), "check", F.lit("history").alias("source"), F.col("m.resource").alias("resource")))
    covered = one.select(key, attribute_category(F.col("attr")).alias("category")).where("category is not null").distinct()
    cps = nodes.where("category <> ''").groupBy(key, "category").agg(F.min(F.struct("ord", "address")).alias("m")).join(covered, [key, "category"], "left_anti")
    lists = F.coalesce(*[F.when(F.col("category") == c, F.array(*map(F.lit, cs))) for c, cs in CATEGORY_CHECKS.items()])
    general = cps.select(key, F.lit(3).alias("step"), "m.ord", F.posexplode(lists).alias("sub", "check"), F.lit("category").alias("source"), F.col("m.address").alias("resource"))
    gone = nodes.where(F.col("action").isin("delete", "replace")).select(key).distinct()
    last = gone.select(key, F.lit(4).alias("step"), F.lit(0).alias("ord"), F.lit(0).alias("sub"), F.lit(DELETE_CHECK).alias("check"), F.lit("category").alias("source"), F.lit("").alias("resource"))
    return out.unionByName(general).unionByName(last)


def category_checks(nodes: DataFrame, key: str) -> DataFrame:
    """key, check: the checks of a plan's categories and of deletion alone."""
    lists = F.coalesce(*[F.when(F.col("category") == c, F.array(*map(F.lit, cs))) for c, cs in CATEGORY_CHECKS.items()], F.array().cast("array<string>"))
    gone = F.when(F.col("action").isin("delete", "replace"), F.array(F.lit(DELETE_CHECK))).otherwise(F.array().cast("array<string>"))
    return nodes.select(key, F.explode(F.concat(lists, gone)).alias("check")).distinct()


# --- earlier ways to look at history ---------------------------------------------------------


def types_in_tags(types: DataFrame, fixes: DataFrame) -> DataFrame:
    """rt, seq: types (column rt) that are a substring of a fix's tags; a type has no comma. Different tags are looked through once."""
    known = types.where("rt <> ''").select(F.col("rt").alias("needle")).distinct()
    tags = fixes.select("seq", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("tags", F.lit(""))), ","))).alias("word"))
    return starts_in(known, tags.select("word").distinct()).join(tags, "word").select(F.col("needle").alias("rt"), "seq").distinct()


def type_history(nodes: DataFrame, fixes: DataFrame, key: str) -> DataFrame:
    """key, address, cloud_provider, seq: for each changing resource the fixes whose tags contain its type."""
    n = nodes.select(key, "address", "cloud_provider", F.lower("resource_type").alias("rt"))
    return n.join(types_in_tags(n, fixes), "rt").select(key, "address", "cloud_provider", "seq")


def type_counts(nodes: DataFrame, fixes: DataFrame, key: str) -> DataFrame:
    """key, address, n: how many rows ``type_history`` has for each changing resource; fixes are counted once a type."""
    n = nodes.select(key, "address", F.lower("resource_type").alias("rt"))
    counts = types_in_tags(n, fixes).groupBy("rt").agg(F.count(F.lit(1)).alias("n"))
    return n.join(counts, "rt").groupBy(key, "address").agg(F.sum("n").alias("n"))


def prior_fixes(nodes: DataFrame, fixes: DataFrame, key: str, most: int = 10, tags_only: bool = False) -> DataFrame:
    """key, place, seq, score, reason, matched: fixes by type alone; a type within the tags scores 100, as a word of the text 60.

    Only the ``most`` best fixes of each type reach the plans: a fix that is not among them has that many better ones
    in every plan with this type.
    """
    n = nodes.select(key, "address", F.lower(F.trim("resource_type")).alias("rt"))
    hits = types_in_tags(n, fixes).withColumn("score", F.lit(100))
    if not tags_only:
        text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("issue", "resolution", "error_excerpt")]))
        words = fixes.select("seq", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\w+"), F.lit(0)))).alias("rt"))
        hits = hits.unionByName(words.join(n.select("rt").distinct(), "rt", "left_semi").select("rt", "seq", F.lit(60).alias("score")))
    hits = settle(hits.groupBy("rt", "seq").agg(F.max("score").alias("score")), "hits")

    def best(rows: DataFrame, by: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), F.desc("at"), "id"))
        return rows.withColumn("place", place).where(F.col("place") <= most)

    dated = hits.join(fixes.select("seq", "id", F.coalesce("created_at", F.lit("")).alias("at")), "seq")
    of_type = settle(best(dated, "rt").drop("place"), "of-type")
    each = n.select(key, "rt").distinct().join(of_type, "rt").groupBy(key, "seq").agg(F.max("score").alias("score"), F.any_value("id").alias("id"), F.any_value("at").alias("at"))
    top = best(each, key).select(key, "place", "seq", "score")
    few = settle(hits.join(of_type.select("seq").distinct(), "seq", "left_semi").select("rt", "seq"), "few")
    matched = top.join(n, key).join(few, ["rt", "seq"]).groupBy(key, "place", "seq", "score").agg(F.countDistinct("address").alias("matched"))
    return matched.select(key, "place", "seq", "score", F.when(F.col("score") == 100, "tag_match").otherwise("text_match").alias("reason"), "matched")


def history_prior(nodes: DataFrame, fixes: DataFrame, key: str, most: int = 3, first: int = 8) -> DataFrame:
    """key, place, seq: fixes that name a changed address, or (with a control point or destruction) have the type and a concern's tag.

    Of fixes with one cluster key the one with an excerpt, then the newest, counts; the first of ``most`` by storage order.

    A type's fixes are reduced to the one that counts in each cluster, with the types that have a better one there. Plans
    read the ``first`` of them by storage order, without those that another of their types beats. Where fewer than
    ``most`` are left before the end of a list that goes on, the plan is settled with longer lists.
    """
    text = F.lower(F.concat_ws(" ", F.nullif("issue", F.lit("")), F.nullif("error_excerpt", F.lit(""))))
    f = fixes.select("seq", "issue", "error_excerpt", "created_at", "tags", text.alias("t"))
    n = nodes.select(key, F.lower("address").alias("whole"), F.lower("resource_type").alias("rt"), (F.col("is_control_point") | F.col("action").isin("delete", "replace")).alias("hard"))
    better = F.struct(F.when(F.coalesce("error_excerpt", F.lit("")) != "", 1).otherwise(0).alias("a"), F.coalesce("created_at", F.lit("")).alias("b"), (-F.col("seq")).alias("c"))
    rated = f.select("seq", cluster_key(F.col("issue")).alias("cluster"), better.alias("better"))

    # The fixes that count of each type and cluster; ``beaten_by`` are the types with a better one.
    concerned = f.where(F.arrays_overlap(comma_tags(F.col("tags")), F.array(*map(F.lit, CONCERNS))))
    counting = types_in_tags(n, concerned).join(rated, "seq").groupBy("rt", "cluster").agg(F.max("better").alias("better"))
    clusters = settle(counting.groupBy("cluster").agg(F.collect_list(F.struct("rt", "better")).alias("all")), "clusters")
    beaten_by = F.transform(F.filter("all", lambda o: o["better"] > F.col("e.better")), lambda o: o["rt"])
    listed = clusters.select("cluster", "all", F.explode("all").alias("e")).select("e.rt", "cluster", (-F.col("e.better.c")).alias("seq"), "e.better", beaten_by.alias("beaten_by"))
    listed = settle(listed.withColumn("turn", F.row_number().over(Window.partitionBy("rt").orderBy("seq"))), "listed")

    hard = n.groupBy(key).agg(F.bool_or("hard").alias("hard")).where("hard")
    types = settle(n.where("rt <> ''").join(hard, key, "left_semi").groupBy(key).agg(F.collect_set("rt").alias("types")), "types")

    # Fixes that name an address, where no type of the plan has a better one.
    spots = f.select("seq", "t", F.explode(anchors(F.col("t"))).alias("anchor"))
    hits = n.select("whole").distinct().withColumn("anchor", anchor(F.col("whole"))).join(spots, "anchor").where(F.col("t").contains(F.col("whole"))).select("whole", "seq")
    named = n.select(key, "whole").distinct().join(hits, "whole").select(key, "seq").distinct().join(rated, "seq").groupBy(key, "cluster").agg(F.max("better").alias("better"))
    named = named.join(types, key, "left").join(clusters, "cluster", "left")
    lost = F.exists("all", lambda o: F.array_contains("types", o["rt"]) & (o["better"] > F.col("better")))
    named = settle(named.where(~F.coalesce(lost, F.lit(False))).select(key, "cluster", "better"), "named")

    done, todo, upto = None, types, first
    while True:
        lists = settle(listed.where(F.col("turn") <= upto), "lists")
        ends = listed.where(F.col("turn") == upto + 1).select("rt", F.col("seq").alias("end"))
        rows = todo.select(key, "types", F.explode("types").alias("rt"))
        limit = rows.join(settle(ends, "ends"), "rt").groupBy(key).agg(F.min("end").alias("end"))
        typed = rows.join(lists, "rt").where(~F.arrays_overlap("types", "beaten_by")).select(key, "cluster", "better")
        mine = named if done is None else named.join(todo, key, "left_semi")
        kept = typed.unionByName(mine).groupBy(key, "cluster").agg(F.max("better").alias("better")).select(key, (-F.col("better.c")).alias("seq"))
        place = F.row_number().over(Window.partitionBy(key).orderBy("seq"))
        shown = kept.withColumn("place", place).where(F.col("place") <= most).join(limit, key, "left")
        # A list's unread rest begins at ``end``: what lies before it stands.
        sure = F.col("end").isNull() | (F.col("seq") < F.col("end"))
        shown = settle(shown.select(key, "place", "seq", "end", sure.alias("sure")), "shown")
        whole = limit.join(shown.where("sure").groupBy(key).agg(F.count(F.lit(1)).alias("sure")), key, "left").where(F.coalesce("sure", F.lit(0)) < most)
        todo = settle(todo.join(whole, key, "left_semi"), "todo")
        part = shown.join(todo, key, "left_anti").select(key, "place", "seq")
        done = part if done is None else done.unionByName(part)
        if todo.isEmpty():
            return done
        upto *= 8


# --- reports ---------------------------------------------------------------------------------


def reports(f: DataFrame, why: DataFrame, told: DataFrame, todo: DataFrame, relevant: DataFrame, fixes: DataFrame, key: str) -> DataFrame:
    """One row a plan: json, line and markdown of its result.

    Lists hold what a reader is shown: the three bullets worth most, the first three checks, the first
    three fixes and the first paths; the whole tables are made by the other functions.
    """

    def top(rows: DataFrame, order: list[Column], value: Column, name: str, most: int = 3) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
        few = rows.withColumn("__p", place).where(F.col("__p") <= most)
        return few.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("__p").alias("place"), value.alias("v")))).alias(name)).select(key, F.transform(name, lambda e: e["v"]).alias(name))

    bullets = top(told.where("kind <> 'modifier'"), [F.desc("delta"), F.col("ord"), F.col("sub")], F.concat(F.lit("+"), F.col("delta").cast("string"), F.lit(" "), F.col("label")), "explanation")
    first_checks = top(todo, [F.col("step"), F.col("ord"), F.col("sub")], F.col("check"), "checks")
    named = relevant.join(fixes.select("seq", "id", "issue"), "seq")
    first_fixes = top(named, [F.col("place")], F.concat(F.left("id", F.lit(8)), F.lit(" "), F.left(F.coalesce("issue", F.lit("")), F.lit(80))), "fixes")
    paths = top(why, [F.col("place")], F.array_join("path", " > "), "paths", 20)
    out = f
    for part in (bullets, first_checks, first_fixes, paths):
        out = out.join(part, key, "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("explanation", "checks", "fixes", "paths")})
    line = F.concat(F.upper("severity"), F.lit(" "), F.col("score").cast("string"), F.lit("/100 | "), F.col("changes").cast("string"), F.lit(" change(s), "), F.col("control_points").cast("string"), F.lit(" control point(s), "), (F.col("l1") + F.col("l2")).cast("string"), F.lit(" affected"))
    section = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"\n### {title}\n\n- "), F.array_join(c, "\n- "), F.lit("\n")))
    page = F.concat_ws("", F.lit("## Plan risk: "), F.upper("severity"), F.lit(" ("), F.col("score").cast("string"), F.lit(")\n"), section("Why", "explanation"), section("Check", "checks"), section("Past fixes", "fixes"), section("Paths", "paths"))
    body = F.to_json(F.struct(*[c for c in out.columns if c != "points"]))
    return out.select(key, line.alias("line"), page.alias("markdown"), body.alias("json"))

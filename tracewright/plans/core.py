"""Queries of the general data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.diff import diff_copies
from tracewright.operators.shred import Shredded, shred
from tracewright.operators.tags import explode_packed
from tracewright.sources.scratch import settle
from tracewright.sources.tables import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """What differs between ``fixes`` and ``fixes_remote``."""
    return diff_copies(load(spark, d, "fixes"), load(spark, d, "fixes_remote"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every tag of every fix and pending error."""

    def of(record: str, table: str) -> DataFrame:
        rows = load(spark, d, table).select("seq", "tags")
        return explode_packed(rows, "tags").select(F.lit(record).alias("record"), "seq", "pos", "tag")

    return of("fix", "fixes").unionByName(of("pending", "pending_errors"))


#: What p5_found needs below resource_changes.
PLAN_ELEMENTS = {"change", "actions", "before", "after_unknown"}


def shredded_plans(spark: SparkSession, d: str, keep: set[str] | None = None) -> Shredded:
    """The flat tables of all plans; of a plan uploaded more than once, its first upload counts.

    An upload is told by its time and content, so a row stored twice gives the same rows twice.
    """
    plans = load(spark, d, "plans")
    upload = F.struct(F.col("received_at"), F.xxhash64("payload").alias("content"))
    got = shred(plans, "payload", "resource_changes", [F.col("plan_id"), upload.alias("upload")], keep)
    nodes = settle(got.nodes, "plan-nodes")
    first = nodes.groupBy("plan_id").agg(F.min("upload").alias("upload"))
    once = nodes.join(first, ["plan_id", "upload"], "left_semi").dropDuplicates(["plan_id", "node"])
    return Shredded(settle(once.drop("upload"), "plans"), got.elements, ["plan_id"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The actions and ARNs of every planned change."""
    tables = shredded_plans(spark, d, PLAN_ELEMENTS)
    changes = tables.table("resource_changes").where(F.col("parent_element").isNull())
    change_pos = changes.select("plan_id", "node", F.col("pos").alias("change_pos"), "attrs")
    blank = lambda c: F.when(c.rlike(r"(?U)\S"), c)

    # The actions' parent is the change element's row, or the resource change's row where it is inlined.
    actions = tables.table("actions")
    owner = tables.table("change").select("plan_id", F.col("node").alias("c_node"), F.col("parent_node").alias("r_node"))
    in_change = F.col("parent_element") == "change"
    linked = (
        actions.where(in_change).join(owner, (actions["plan_id"] == owner["plan_id"]) & (actions["parent_node"] == owner["c_node"])).select(actions["plan_id"], F.col("r_node").alias("node"), "pos", "attrs")
        if "change" in tables.elements
        else actions.where(F.col("parent_element") == "resource_changes").select("plan_id", F.col("parent_node").alias("node"), "pos", "attrs")
    )
    action = linked.join(change_pos.drop("attrs"), ["plan_id", "node"]).select(
        "plan_id", "change_pos", F.lit("action").alias("leaf"), F.col("pos").alias("leaf_pos"), F.col("attrs")["value"].alias("leaf_value")
    )
    wide = tables.column(change_pos, "resource_changes", "change.before.arn", "before_arn")
    wide = tables.column(wide, "resource_changes", "change.after_unknown.arn", "after_unknown_arn")
    # An action given as a plain value instead of an array is a column of its change, not a row of the actions' table.
    wide = tables.column(wide, "resource_changes", "change.actions", "action")
    leaves = {"action": blank(F.col("action")), "before_arn": blank(F.col("before_arn")), "after_unknown_arn": F.col("after_unknown_arn")}
    single = wide.select(
        "plan_id",
        "change_pos",
        F.stack(F.lit(len(leaves)), *[x for leaf, value in leaves.items() for x in (F.lit(leaf), value)]).alias("leaf", "leaf_value"),
    ).where("leaf_value is not null")
    return action.unionByName(single.withColumn("leaf_pos", F.lit(1)))


def p5_elements(spark: SparkSession, d: str) -> DataFrame:
    """All flat tables of the plans as one: element, plan, row, parent's element and row, position, and columns as JSON."""
    nodes = shredded_plans(spark, d).nodes
    return nodes.select("plan_id", "element", "node", "parent_element", "parent_node", "pos", F.to_json("attrs").alias("columns"))


def p5_changes(spark: SparkSession, d: str) -> DataFrame:
    """The table of planned changes with keys: plan, row, position, and the columns most asked for."""
    tables = shredded_plans(spark, d, PLAN_ELEMENTS)
    rows = tables.table("resource_changes").where(F.col("parent_element").isNull())
    return rows.select("plan_id", "node", F.col("pos").alias("change_pos"), *[F.col("attrs")[c].alias(c) for c in ("address", "type", "name", "provider_name")])


QUERIES = {"p5_elements": p5_elements, "p5_changes": p5_changes, "p1_found": p1_found, "p2_found": p2_found, "p5_found": p5_found}
SQL: dict[str, str] = {}

"""Queries of graphs, change sets, and the relational groundwork over the star-schema tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.functions.fields import changed_keys
from tracewright.operators.graph import reached
from tracewright.sources.tables import load

#: Action of a change by its flag.
ACTIONS = {"A": "create", "R": "delete", "N": "update"}
#: Kinds of things by the beginning of their type, of which the longest counts.
PREFIXES = [("STANDARD", "standard"), ("STANDARD BRUSHED", "standard-brushed"), ("SMALL", "small"), ("PROMO", "promo"), ("PROMO PLATED", "promo-plated"), ("ECONOMY", "economy"), ("E", "other-e"), ("p", "p"), ("m", "m")]


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """What depends on what: orders on customers, customers and suppliers on nations, nations on regions."""
    node = lambda kind, c: F.concat(F.lit(kind + "."), F.col(c).cast("string"))
    parts = [
        load(spark, d, "orders").select(node("order", "o_orderkey").alias("src"), node("customer", "o_custkey").alias("dst")),
        load(spark, d, "customer").select(node("customer", "c_custkey").alias("src"), node("nation", "c_nationkey").alias("dst")),
        load(spark, d, "supplier").select(node("supplier", "s_suppkey").alias("src"), node("nation", "s_nationkey").alias("dst")),
        load(spark, d, "nation").select(node("nation", "n_nationkey").alias("src"), node("region", "n_regionkey").alias("dst")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges by kind of both ends."""
    kind = lambda c: F.substring_index(c, ".", 1)
    return _edges(spark, d).groupBy(kind("src").alias("src_kind"), kind("dst").alias("dst_kind")).agg(F.count(F.lit(1)).alias("n"))


def reached_within_three(spark: SparkSession, d: str) -> DataFrame:
    """What three steps from region 1 reach, by depth and kind."""
    starts = spark.createDataFrame([("region.1",)], "node string")
    got = reached(_edges(spark, d), starts, 3)
    return got.groupBy("depth", F.substring_index("node", ".", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("via").alias("first_via"))


def reached_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """The suppliers that two regions reach, with depth and the node they are reached through."""
    starts = spark.createDataFrame([("region.0",), ("region.2",)], "node string")
    return reached(_edges(spark, d), starts, 2).where(F.col("node").startswith("supplier."))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    action = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])[F.col("l_returnflag")]
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", action.alias("action"))


def change_actions(spark: SparkSession, d: str) -> DataFrame:
    """Per plan: number of changes, and whether it creates, deletes, or only updates."""
    return _changes(spark, d).groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("action") == "create").alias("creates"), F.bool_or(F.col("action") == "delete").alias("deletes"), F.bool_and(F.col("action") == "update").alias("only_updates")
    )


def change_summary(spark: SparkSession, d: str) -> DataFrame:
    """Changes by action, by part size, and in all."""
    rows = _changes(spark, d).join(load(spark, d, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return spark.sql("SELECT action, p_size, count(*) AS n FROM {changes} GROUP BY GROUPING SETS ((action), (p_size), ())", changes=rows)


def longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Parts by the kind whose prefix of their type is longest."""
    dim = spark.createDataFrame(PREFIXES, "prefix string, kind string")
    part = load(spark, d, "part").select("p_partkey", "p_type")
    met = part.join(F.broadcast(dim), part["p_type"].startswith(dim["prefix"]), "left")  # a fixed list
    best = met.groupBy("p_partkey").agg(F.max_by("kind", F.length("prefix")).alias("kind"))
    return best.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def changed_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Which attributes differ between neighbouring lines of an order."""
    names = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    values = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("string") for n in names]))
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", values.alias("v"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    after = F.lead("v").over(Window.partitionBy("l_orderkey").orderBy(*order))
    pairs = rows.withColumn("after", after).where("after is not null")
    return pairs.groupBy(F.array_join(changed_keys(F.col("v"), F.col("after")), ",").alias("changed")).agg(F.count(F.lit(1)).alias("n"))


def as_of_purchase(spark: SparkSession, d: str) -> DataFrame:
    """For each purchase the user's latest view before it: an as-of join in one sort per user."""
    events = load(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts"))
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(before)
    return events.withColumn("view_id", seen).where("event_type = 'purchase'").select("event_id", "view_id")


_CASTS = {"money": "CAST({} AS DECIMAL(18,4))"}
_M = lambda c: _CASTS["money"].format(c)

#: One text for both engines: the relational groundwork.
_SHARED = {
    "base_groups": f"SELECT l_returnflag, l_linestatus, sum({_M('l_quantity')}) AS sum_qty, sum({_M('l_extendedprice')}) AS sum_base, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "base_top_orders": f"SELECT o_orderkey, sum({_M('l_extendedprice')}) AS revenue, o_orderpriority FROM customer JOIN orders ON c_custkey=o_custkey JOIN lineitem ON l_orderkey=o_orderkey WHERE c_mktsegment='BUILDING' GROUP BY o_orderkey, o_orderpriority ORDER BY revenue DESC, o_orderkey LIMIT 10",
    "base_star_join": f"SELECT n_name, sum({_M('l_extendedprice')}) AS revenue FROM customer JOIN orders ON c_custkey=o_custkey JOIN lineitem ON l_orderkey=o_orderkey JOIN supplier ON l_suppkey=s_suppkey AND c_nationkey=s_nationkey JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY n_name",
    "base_filtered_sum": f"SELECT sum({_M('l_extendedprice')}) AS revenue, count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "base_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderstatus='P')",
    "base_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderstatus='P')",
    "base_full": "SELECT coalesce(c_nationkey, s_nationkey) AS k, c, s FROM (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) b ON a.c_nationkey=b.s_nationkey",
    "base_rollup": f"SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum({_M('o_totalprice')}) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "base_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "base_rank": "SELECT c_nationkey, c_custkey, rk FROM (SELECT c_nationkey, c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rk FROM customer) t WHERE rk <= 3",
    "base_frame": f"SELECT o_custkey, o_orderkey, sum({_M('o_totalprice')}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent FROM orders",
    "base_lag": "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events",
    "base_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier",
    "base_except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 49",
    "base_distinct_counts": "SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY event_type",
    "base_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15",
}


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _shared(text: str):  # noqa: ANN202
    """The text as a query over the tables, which are passed to it; no view is left in the session."""
    named = re.sub(rf"\b(FROM|JOIN) ({'|'.join(_TABLES)})\b", r"\1 {\2}", text)

    def run(spark: SparkSession, d: str) -> DataFrame:
        return spark.sql(named, **{t: load(spark, d, t) for t in _TABLES if "{" + t + "}" in named})

    return run


QUERIES = {
    **{f.__name__: f for f in (graph_edges, reached_within_three, reached_suppliers, change_actions, change_summary, longest_prefix, changed_attributes, as_of_purchase)},
    **{k: _shared(v) for k, v in _SHARED.items()},
}
_E = "edges AS (SELECT 'order.'||o_orderkey AS src, 'customer.'||o_custkey AS dst FROM orders UNION ALL SELECT 'customer.'||c_custkey, 'nation.'||c_nationkey FROM customer UNION ALL SELECT 'supplier.'||s_suppkey, 'nation.'||s_nationkey FROM supplier UNION ALL SELECT 'nation.'||n_nationkey, 'region.'||n_regionkey FROM nation)"
_CASE = "CASE l_returnflag " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items()) + " END"


def _bfs(starts: str, depth: int) -> str:
    return f"WITH RECURSIVE {_E}, b AS (SELECT node, 0 AS depth, CAST(NULL AS VARCHAR) AS via FROM (VALUES {starts}) v(node) UNION ALL SELECT e.src, b.depth+1, e.dst FROM b JOIN edges e ON e.dst=b.node WHERE b.depth<{depth}), g AS (SELECT node, min(depth) AS depth, min(via) AS via FROM b WHERE depth>0 GROUP BY node)"


SQL = {
    "graph_edges": f"WITH {_E} SELECT split_part(src,'.',1) AS src_kind, split_part(dst,'.',1) AS dst_kind, count(*) AS n FROM edges GROUP BY 1,2",
    "reached_within_three": _bfs("('region.1')", 3) + " SELECT depth, split_part(node,'.',1) AS kind, count(*) AS n, min(via) AS first_via FROM g GROUP BY 1,2",
    "reached_suppliers": _bfs("('region.0'),('region.2')", 2) + " SELECT node, depth, via FROM g WHERE starts_with(node,'supplier.')",
    "change_actions": f"SELECT l_orderkey, count(*) AS n, bool_or(a='create') AS creates, bool_or(a='delete') AS deletes, bool_and(a='update') AS only_updates FROM (SELECT l_orderkey, {_CASE} AS a FROM lineitem) GROUP BY 1",
    "change_summary": f"SELECT action, p_size, count(*) AS n FROM (SELECT {_CASE} AS action, p_size FROM lineitem JOIN part ON l_partkey=p_partkey) GROUP BY GROUPING SETS ((action),(p_size),())",
    "longest_prefix": "SELECT kind, count(*) AS n FROM (SELECT p_partkey, arg_max(kind, length(prefix)) AS kind FROM part LEFT JOIN (VALUES %s) v(prefix, kind) ON starts_with(p_type, prefix) GROUP BY 1) GROUP BY 1" % ", ".join(f"('{a}','{b}')" for a, b in PREFIXES),
    "changed_attributes": "WITH w AS (SELECT *, lead(l_linenumber) OVER o AS nx, lead(l_quantity) OVER o AS q, lead(l_discount) OVER o AS dd, lead(l_tax) OVER o AS t, lead(l_returnflag) OVER o AS r, lead(l_linestatus) OVER o AS s FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)) SELECT array_to_string(list_sort(list_filter([CASE WHEN l_quantity<>q THEN 'l_quantity' END, CASE WHEN l_discount<>dd THEN 'l_discount' END, CASE WHEN l_tax<>t THEN 'l_tax' END, CASE WHEN l_returnflag<>r THEN 'l_returnflag' END, CASE WHEN l_linestatus<>s THEN 'l_linestatus' END], lambda x: x IS NOT NULL)),',') AS changed, count(*) AS n FROM w WHERE nx IS NOT NULL GROUP BY 1",
    "as_of_purchase": "SELECT event_id, view_id FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type='view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS view_id FROM events) WHERE event_type='purchase'",
    **_SHARED,
}

"""What a change reaches: bounded breadth-first search over an edge list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.sources.scratch import settle


def dot_edges(lines: Column) -> Column:
    """src, dst of a line of a dependency graph in DOT, as a struct; null for other lines.

    Escaped quotes are part of a name; marks such as ``[root] `` and `` (expand)`` are not.
    """
    quoted = r'"((?:[^"\\]|\\.)*)"'
    bare = r"([^\s\"]+?)"
    pattern = rf"^\s*(?:{quoted}|{bare})\s*->\s*(?:{quoted}|{bare})\s*(?:\[.*)?;?\s*$"
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"\\(.)", "$1"), r"^\[root\] | \((?:expand|close)\)$", ""))
    either = lambda a, b: F.concat(F.regexp_extract(lines, pattern, a), F.regexp_extract(lines, pattern, b))
    return F.when(lines.rlike(pattern), F.struct(plain(either(1, 2)).alias("src"), plain(either(3, 4)).alias("dst")))


def _levels(edges: DataFrame, starts: DataFrame, depth: int, keys: list[str], first: Column, step: Column) -> DataFrame:
    """keys, node, depth, how: breadth-first levels; ``first`` is a start's ``how``, ``step`` that of a node met over an edge.

    The edges are written once. Each level joins the frontier with them, keeps the least ``how`` of a
    node, and drops what was seen; levels are written, so that the plan does not grow and a lost
    executor costs one level.
    """
    edges = settle(edges.select(*keys, "src", "dst").distinct(), "edges")
    seen = settle(starts.select(*keys, "node").distinct().withColumns({"depth": F.lit(0), "how": first}), "reached")
    frontier = seen
    for level in range(1, depth + 1):
        met = frontier.withColumnRenamed("node", "dst").join(edges, [*keys, "dst"]).groupBy(*keys, F.col("src").alias("node")).agg(F.min(step).alias("how"))
        new = met.join(seen.select(*keys, "node"), [*keys, "node"], "left_anti")
        frontier = settle(new.select(*keys, "node", F.lit(level).alias("depth"), "how"), "reached")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def reached(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """node, depth, via: nodes within ``depth`` steps against the edges (src depends on dst), starts left out.

    ``edges``: src, dst; ``starts``: node. ``via`` is the least of the nodes it is reached from.
    """
    return _levels(edges, starts, depth, [], F.lit(None).cast("string"), F.col("dst")).withColumnRenamed("how", "via")


def propagate(edges: DataFrame, starts: DataFrame, depth: int, key: str) -> DataFrame:
    """key, node, depth, path: as ``reached`` in many graphs at once (``key`` tells them), with the least of the shortest paths from a start."""
    path = F.array("node")
    return _levels(edges, starts, depth, [key], path, F.array_append("how", F.col("src"))).withColumnRenamed("how", "path")

"""Nested JSON as related flat tables, by shared inlining over the schema graph.

``schema_graph`` finds, over all documents, which elements occur below which, and whether repeated.
An element is inlined into its parent's table if it occurs at most once in it, below one kind of
parent only, and not below itself; repeated, shared and recursive elements get tables of their own,
whose rows hold the document, the parent's table and row, and the position. Scalars are columns.

``shred`` yields all tables as one long table (``element`` tells which), so that the documents are
parsed once; ``Shredded.column`` finds a path's value wherever the mapping put it.

Cases with a defined result: null, empty and unreadable payloads give no rows; a byte-order mark is
ignored; any object or array may be given as JSON text, at any depth; null members are absent;
empty objects and arrays give no columns or rows; of a repeated key the last counts.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The schema graph is brought to the driver; more edges than this are refused, as they would be data, not schema.
MAX_GRAPH_EDGES = 100_000

_EDGES = "parent string, child string, repeated boolean"
_NODES = "element string, node int, parent_element string, parent_node int, pos int, attrs map<string,string>"


def decode(value: Any) -> Any:
    """``value``, or what it says if it is JSON text of an object or array."""
    while isinstance(value, str):
        text = value.lstrip("﻿ \t\r\n")
        if text[:1] not in ("{", "[", '"'):
            return value
        try:
            inner = json.loads(text)
        except (ValueError, RecursionError):
            return value
        if isinstance(inner, str) and inner == value or not isinstance(inner, (dict, list, str)):
            return value
        if isinstance(inner, str) and not isinstance(decode(inner), (dict, list)):
            return value
        value = inner
    return value


def find_member(payload: str | None, member: str) -> list | None:
    """The array ``member`` of the outermost object that has one; None if there is none."""
    if not payload:
        return None
    queue = deque([decode(payload)])
    while queue:
        at = queue.popleft()
        if isinstance(at, dict):
            if member in at and isinstance(found := decode(at[member]), list):
                return found
            queue.extend(d for v in at.values() if isinstance(d := decode(v), (dict, list)))
        elif isinstance(at, list):
            queue.extend(d for v in at if isinstance(d := decode(v), (dict, list)))
    return None


def _scalar(value: Any) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _edges(element: str, value: Any, out: set[tuple[str, str, bool]]) -> None:
    stack = [(element, value)]
    while stack:
        name, at = stack.pop()
        at = decode(at)
        if isinstance(at, list):
            for item in at:  # an array in an array is an element of the same kind
                item = decode(item)
                if isinstance(item, list):
                    out.add((name, name, True))
                stack.append((name, item))
        elif isinstance(at, dict):
            for k, v in at.items():
                v = decode(v)
                if isinstance(v, (dict, list)):
                    out.add((name, k, isinstance(v, list)))
                    stack.append((k, v))


def schema_graph(df: DataFrame, payload: str, member: str) -> set[tuple[str, str, bool]]:
    """The edges (parent, child, repeated) of the elements at and below ``member``, over all documents.

    Each task sends an edge once; what comes to the driver is bounded by MAX_GRAPH_EDGES.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[str, str, bool]] = set()
        for batch in batches:
            new: set[tuple[str, str, bool]] = set()
            for text in batch[payload]:
                if (found := find_member(text, member)) is not None:
                    _edges(member, found, new)
            new -= seen
            seen |= new
            yield pd.DataFrame(sorted(new), columns=["parent", "child", "repeated"])

    edges = df.select(payload).mapInPandas(scan, _EDGES).distinct().limit(MAX_GRAPH_EDGES + 1).collect()
    if len(edges) > MAX_GRAPH_EDGES:
        raise ValueError("the schema graph has too many edges: are keys used as data?")
    return {(e.parent, e.child, e.repeated) for e in edges}


def own_tables(graph: set[tuple[str, str, bool]], root: str) -> set[str]:
    """The elements that need a table: the root, and what is repeated, shared or recursive."""
    parents: dict[str, set[str]] = {}
    children: dict[str, set[str]] = {}
    repeated = set()
    for p, c, many in graph:
        parents.setdefault(c, set()).add(p)
        children.setdefault(p, set()).add(c)
        if many:
            repeated.add(c)
    recursive = set()
    for start in children:
        todo, seen = list(children[start]), set()
        while todo:
            if (c := todo.pop()) not in seen:
                seen.add(c)
                todo += children.get(c, ())
        if start in seen:
            recursive.add(start)
    return {root} | repeated | recursive | {c for c, ps in parents.items() if len(ps) > 1}


def _shred_one(found: list, root: str, tables: set[str], keep: set[str] | None) -> list[tuple]:
    """The rows of one document; parents precede children. Elements outside ``keep`` are passed over."""
    rows: list[tuple] = []
    count = 0

    def inline(prefix: str, obj: dict, attrs: dict[str, str], below: list) -> None:
        todo = [(prefix, obj)]
        while todo:
            path, at = todo.pop()
            for k, v in at.items():
                v = decode(v)
                name = f"{path}{k}"
                if isinstance(v, (dict, list)):
                    if k in tables or isinstance(v, list):
                        below.append((k, v))
                    else:
                        todo.append((f"{name}.", v))
                elif v is not None:
                    attrs[name] = _scalar(v)

    # (element, value, parent element, parent node): an array's items are rows with positions from 1
    todo: deque[tuple] = deque([(root, found, None, None)])
    while todo:
        element, value, parent, parent_node = todo.popleft()
        for pos, item in enumerate(value if isinstance(value, list) else [value], 1):
            item = decode(item)
            if item is None:
                continue
            attrs: dict[str, str] = {}
            below: list = []
            if isinstance(item, dict):
                inline("", item, attrs, below)
            elif isinstance(item, list):
                below.append((element, item))
            else:
                attrs["value"] = _scalar(item)
            count += 1
            rows.append((element, count, parent, parent_node, pos, attrs))
            todo.extend((k, v, element, count) for k, v in below if keep is None or k in keep)
    return rows


@dataclass(frozen=True)
class Shredded:
    """The tables: ``nodes`` holds all rows; ``elements`` names the elements with a table of their own."""

    nodes: DataFrame
    elements: frozenset[str]
    document: list[str]

    def table(self, element: str) -> DataFrame:
        """One element's table: document, node, parent_element, parent_node, pos, attrs."""
        return self.nodes.where(F.col("element") == element).drop("element")

    def column(self, base: DataFrame, element: str, path: str, name: str) -> DataFrame:
        """``base`` (rows of ``element``'s table) with the value at ``path`` below it as column ``name``.

        Follows foreign keys where a step of the path has its own table; null where it is absent.
        """
        steps = path.split(".")
        for i, step in enumerate(steps[:-1]):
            if step in self.elements:
                inner = self.table(step).where((F.col("parent_element") == element) & (F.col("pos") == 1))
                inner = self.column(inner, step, ".".join(steps[i + 1 :]), "__value")
                inner = inner.select(*self.document, F.col("parent_node").alias("node"), F.col("__value").alias(name))
                return base.join(inner, [*self.document, "node"], "left")
        return base.withColumn(name, F.col("attrs")[path])


def shred(df: DataFrame, payload: str, member: str, document: list[Column], keep: set[str] | None = None) -> Shredded:
    """Shreds the array ``member`` of each payload. ``document``: the columns that tell a document.

    ``keep``: the elements below ``member`` that are wanted (all, if None).
    """
    tables = own_tables(schema_graph(df, payload, member), member)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *doc, text in batch.itertuples(index=False, name=None):
                if (found := find_member(text, member)) is not None:
                    rows += [(*doc, *r) for r in _shred_one(found, member, tables, keep)]
            yield pd.DataFrame(rows, columns=[*batch.columns[:-1], "element", "node", "parent_element", "parent_node", "pos", "attrs"]).astype(
                {"parent_node": "Int32"}
            )

    source = df.select(*document, F.col(payload).alias("__payload"))
    names = source.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    nodes = source.mapInPandas(parse, f"{schema}, {_NODES}")
    return Shredded(nodes, frozenset(tables), names)

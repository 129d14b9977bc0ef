"""Splitting texts at natural boundaries by structure-tree packing.

A text is parsed once, line by line, into a tree: sections nest by heading level, rules and blank
lines part blocks, list items nest by their indentation, log records and definitions follow one
another; a fenced block is one node, in which nothing counts as a heading, item or empty line. A leaf
that exceeds the limit is parsed further when it is entered: into lines, sentences, records and fields
of machine-made lines, words, tokens. A node is a range of the text, and its size the number of tokens there.

Packing goes bottom-up: the nodes below every oversized node are packed before it, and siblings that
fit the limit together become one piece; only oversized nodes are entered. Each piece but the first
starts the given number of tokens before its natural start, so neighbours overlap; what is reached is
told in ``overlap``.

Cases with a defined result: null and empty texts have no pieces; a text within the limit is one
piece, itself; without any boundary a text is cut between tokens, never inside a character; the
last piece is not padded; a fence that never closes ends with the text; repeated ids give their pieces again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.tokens import Bpe, bpe

_LINE = re.compile(r"[^\n]*\n|[^\n]+\Z")
_FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"(#{1,6})[ \t]+\S")
_RULE = re.compile(r"(?:-{3,}|={3,}|\*{3,}|_{3,})[ \t]*$")
_MARK = re.compile(r"([ \t]*)(?:[-*+]|\d{1,9}[.)])[ \t]+\S")
#: Lines that open a record: log times, error boxes, definitions, a plan's resources.
_RECORD_LINE = re.compile(r"\[?\d{1,4}[-:/]\d\d|╷|Error\b|(?:resource|module|variable|output|data|provider|locals)\b|  # ")
#: How leaves are parsed further: each level's boundaries lie at the ends of the matches.
_INNER = [
    ("line", re.compile(r"\n")),
    ("sentence", re.compile(r"(?<=[.!?;])(?<!\.\.)\s+(?=\S)|(?<=[。！？；])")),
    ("record", re.compile(r"(?<=[}\])][,;])(?=\s*[{\[(])")),
    ("field", re.compile(r"(?<=[,;|，、])(?=\S)(?!\d)")),
    ("word", re.compile(r"\s+(?=\S)")),
]
#: Ranks tell what lies below what: headings 1 to 6, rules, blocks, then items and their blocks by indentation.
_RULE_RANK, _BLOCK_RANK, _ITEM_RANK, _RECORD_RANK = 7, 8, 9, 10**6
_INNER_RANK = _RECORD_RANK + 1


#: Packings of a text with less and less room, before single overlaps are cut short.
_ATTEMPTS = 12


@dataclass
class Node:
    """Characters [start, end) of a text, what they are, and the nodes they are made of (none: not parsed further)."""

    start: int
    end: int
    kind: str
    rank: int
    children: list[Node] = field(default_factory=list)


def _width(blanks: str) -> int:
    return len(blanks.expandtabs(4))


def _marks(text: str) -> Iterator[tuple[int, int, str]]:
    """Where nodes begin: position, rank and kind, in order."""
    fence = ""  # what closes the open fence
    fresh = True  # after an empty line, a heading, a rule or a fence: a block begins
    items: list[int] = []  # indentations of the open items
    for m in _LINE.finditer(text):
        at, line = m.start(), m[0].rstrip("\n")
        f = _FENCE.match(line)
        if fence:
            if f and f[1].startswith(fence) and not line[f.end() :].strip():
                fence, fresh = "", True
            continue
        if f:
            yield at, _ITEM_RANK + 2 * _width(line[: f.start(1)]) + 1 if items and line[:1] in " \t" else _BLOCK_RANK, "fence"
            fence, fresh = f[1], True
            continue
        bare = line.lstrip(" \t")
        if not bare:
            fresh = True
            continue
        indent = _width(line[: len(line) - len(bare)])
        while items and indent < items[-1]:
            items.pop()
        if h := _HEADING.match(line):
            items.clear()
            yield at, len(h[1]), f"h{len(h[1])}"
            fresh = True
        elif _RULE.match(line):
            items.clear()
            yield at, _RULE_RANK, "rule"
            fresh = True
        elif _MARK.match(line):
            if fresh and not items:
                yield at, _BLOCK_RANK, "block"
            if not items or indent > items[-1]:
                items.append(indent)
            yield at, _ITEM_RANK + 2 * indent, "item"
            fresh = False
        else:
            if fresh:
                if items and indent > items[-1]:
                    yield at, _ITEM_RANK + 2 * items[-1] + 1, "block"
                else:
                    items.clear()
                    yield at, _BLOCK_RANK, "block"
            if not items and _RECORD_LINE.match(line):
                yield at, _RECORD_RANK, "entry"
            fresh = False


def parse(text: str) -> Node:
    """The tree of a text. Siblings follow one another without gaps; text before a node's first child is a child too."""
    root = Node(0, len(text), "text", -1)
    path = [root]
    for at, rank, kind in _marks(text):
        while path[-1].rank >= rank:
            path.pop().end = at
        up = path[-1]
        if at == up.start:
            node = Node(at, len(text), up.kind, rank)  # begins where its parent does, at the parent's boundary
        else:
            if not up.children:
                up.children.append(Node(up.start, at, up.kind, rank))
            node = Node(at, len(text), kind, rank)
        up.children.append(node)
        path.append(node)
    return root


def _enter(text: str, node: Node) -> bool:
    """Parses a leaf further, at the coarsest level below it that has a boundary inside; whether there is one."""
    first = max(0, node.rank - _INNER_RANK + 1)
    for i in range(first, len(_INNER)):
        kind, pattern = _INNER[i]
        inside = [m.end() for m in pattern.finditer(text, node.start, node.end) if node.start < m.end() < node.end]
        if kind == "word":
            inside = [e for e in inside if not text[e].isspace()]
        if inside:
            edges = [node.start, *inside, node.end]
            node.children = [Node(a, b, node.kind if a == node.start else kind, _INNER_RANK + i) for a, b in zip(edges, edges[1:])]
            return True
    return False


@dataclass(frozen=True)
class Piece:
    """A piece: characters [start, end) of the text, its natural start, its tokens, the overlap's tokens, and the kind of its boundary."""

    start: int
    natural_start: int
    end: int
    tokens: int
    overlap: int
    level: str


class Splitter:
    """Cuts texts into pieces of at most ``limit`` tokens that share ``overlap`` tokens with the piece before."""

    def __init__(self, model: Bpe, limit: int, overlap: int) -> None:
        if not 0 <= overlap < limit:
            raise ValueError("the overlap must be less than the limit")
        self.model, self.limit, self.overlap = model, limit, overlap

    def split(self, text: str, ends: np.ndarray | None = None) -> list[Piece]:
        """The pieces, in order; their natural ranges follow one another and cover the text. ``ends``: the text's token ends, if known."""
        if not text:
            return []
        ends = self.model.ends(text) if ends is None else ends
        if len(ends) <= self.limit:
            return [Piece(0, 0, len(text), len(ends), 0, "text")]
        # A piece is cut out of the text, and may have more tokens there than inside it: then all are packed with less room.
        room = self.limit - self.overlap
        for attempt in range(_ATTEMPTS):
            last = attempt == _ATTEMPTS - 1 or room <= 1
            cuts = self._cuts(text, ends, max(1, room))
            stops = [*[a for a, _ in cuts[1:]], len(text)]
            pieces = [self._piece(text, ends, a, b, level, last) for (a, level), b in zip(cuts, stops, strict=True)]
            excess = max(p.tokens for p in pieces) - self.limit
            if excess <= 0 or last:
                break
            room -= excess
        return pieces

    def _piece(self, text: str, ends: np.ndarray, a: int, b: int, level: str, shrink: bool) -> Piece:
        start = a
        if a and self.overlap:
            # Tokens that end at or before the natural start; the overlap begins after the token before them.
            before = int(np.searchsorted(ends, a, side="right"))
            first = max(0, before - self.overlap)
            start = int(ends[first - 1]) if first else 0
        n = self.model.count(text[start:b])
        while shrink and n > self.limit and start < a:
            start = min(a, start + n - self.limit)
            n = self.model.count(text[start:b])
        reached = int(np.searchsorted(ends, a, side="right") - np.searchsorted(ends, start, side="right")) if start < a else 0
        return Piece(start, a, b, n, reached, level)

    def _cuts(self, text: str, ends: np.ndarray, room: int) -> list[tuple[int, str]]:
        """Where pieces begin naturally, with the kind of the boundary."""
        root = parse(text)
        oversized = []  # parents before children
        todo = [root]
        while todo:
            node = todo.pop()
            oversized.append(node)
            if node.children or _enter(text, node):
                todo += [c for c in node.children if _tokens(ends, c.start, c.end) > room]
        packed: dict[int, list[tuple[int, str]]] = {}
        for node in reversed(oversized):
            if node.children:
                packed[id(node)] = self._merge(ends, node.children, room, packed)
            else:
                edges = _by_token(ends, node.start, node.end, room)
                packed[id(node)] = [(x, node.kind if x == node.start else "token") for x in edges]
        return packed[id(root)]

    @staticmethod
    def _merge(ends: np.ndarray, siblings: list[Node], room: int, packed: dict[int, list[tuple[int, str]]]) -> list[tuple[int, str]]:
        """The pieces of siblings: runs that fit together are one, an oversized sibling gives its own pieces."""
        out: list[tuple[int, str]] = []
        begun = None  # start of the run that can still grow
        for s in siblings:
            if id(s) in packed:
                out += packed.pop(id(s))
                begun = None
            elif begun is None or _tokens(ends, begun, s.end) > room:
                out.append((s.start, s.kind))
                begun = s.start
        return out


def _tokens(ends: np.ndarray, a: int, b: int) -> int:
    """Tokens that lie in or touch the characters [a, b)."""
    return int(np.searchsorted(ends, b, side="left") - np.searchsorted(ends, a, side="right")) + 1


def _by_token(ends: np.ndarray, a: int, b: int, room: int) -> list[int]:
    """Starts of ranges of ``room`` tokens in a stretch without any boundary, each at a character."""
    starts = [a]
    while True:
        last = int(np.searchsorted(ends, starts[-1], side="right")) + room - 1
        if last >= len(ends) or ends[last] >= b:
            return starts
        starts.append(max(int(ends[last]), starts[-1] + 1))


def split_texts(docs: DataFrame, limits: list[tuple[int, int, int]], vocabulary: str) -> DataFrame:
    """limit_id, doc_id, piece, pieces, start, natural_start, n_tokens, overlap, level, text: the pieces of ``docs`` (doc_id, text), from 1.

    ``limits``: id, most tokens and overlap of each size wanted; a text is read and tokenized once for
    all of them. ``start`` and ``natural_start`` are character positions in the document; ``level`` tells
    at what kind of boundary the piece begins.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = bpe(vocabulary)
        splitters = [(i, Splitter(model, most, overlap)) for i, most, overlap in limits]
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ends = model.ends(text)
                for i, splitter in splitters:
                    pieces = splitter.split(text, ends)
                    rows += [(i, doc, k, len(pieces), p.start, p.natural_start, p.tokens, p.overlap, p.level, text[p.start : p.end]) for k, p in enumerate(pieces, 1)]
            yield pd.DataFrame(rows, columns=["limit_id", "doc_id", "piece", "pieces", "start", "natural_start", "n_tokens", "overlap", "level", "text"])

    have = docs.select("doc_id", "text").where(F.length("text") > 0)
    return have.mapInPandas(run, "limit_id int, doc_id long, piece int, pieces int, start int, natural_start int, n_tokens int, overlap int, level string, text string")

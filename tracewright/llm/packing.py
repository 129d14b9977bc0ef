"""Filling containers of fixed capacity by exact complements.

All that the packing needs is how many items there are of each length, and there are no more lengths
than the capacity. From these counts ``plan`` makes patterns (lengths that fill a container
together, with the number of containers filled so), each as often as the counts allow:

1. start with the longest length left, and add the longest that fits while the gap is out of reach;
2. close the gap exactly with one length, a pair or a triple whose sum is the gap;
3. what has no exact complement is filled best-fit.

Items then find their place by their rank within their length, in a distributed pass. No length's
items are gathered in one task: ranks are counted within salted groups, whose offsets are added.

Cases with a defined result: items longer than the capacity, and only those, are cut into full pieces
and a rest; items without tokens take no space and go to container 0; null texts count as empty;
repeated ids are items of their own only if ``item`` differs; no items make no containers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Items of one length that one task ranks, on average; more are split by a salt.
RANKED_AT_ONCE = 100_000


@dataclass(frozen=True)
class Pattern:
    """Lengths that share a container, longest first, and how many containers are filled so."""

    lengths: tuple[int, ...]
    copies: int


class _Counts:
    """Items left of each length."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n

    def longest(self, at_most: int) -> int:
        """The longest length up to ``at_most`` of which an item is left; 0 if none."""
        have = np.flatnonzero(self.left[1 : at_most + 1])
        return int(have[-1]) + 1 if len(have) else 0

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.left[gap] else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """The most uneven pair of lengths with this sum."""
        half = gap // 2
        small = np.arange(1, half + 1)
        fits = (self.left[small] > 0) & (self.left[gap - small] > 0)
        if gap % 2 == 0 and half:
            fits[-1] = self.left[half] >= 2
        at = np.flatnonzero(fits)
        return (gap - int(small[at[0]]), int(small[at[0]])) if len(at) else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """Lengths a >= b >= c with this sum, with a as long as possible."""
        have = np.flatnonzero(self.left[1 : gap - 1]) + 1
        for a in have[::-1]:
            if 3 * a < gap:
                return None
            self.left[a] -= 1
            rest = self.pair(gap - int(a))
            self.left[a] += 1
            if rest:
                return (int(a), *rest)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that use every item of ``counts`` (length to number of items, 1 to capacity) once."""
    have = _Counts(counts, capacity)
    patterns = []
    while first := have.longest(capacity):
        chosen = [first]
        have.left[first] -= 1
        gap = capacity - first
        while gap and (top := have.longest(gap)):
            # No triple of what fits can reach a gap beyond three times the longest.
            if gap <= 3 * top and (close := have.single(gap) or have.pair(gap) or have.triple(gap)):
                chosen += close
                gap = 0
                for c in close:
                    have.left[c] -= 1
                break
            chosen.append(top)
            have.left[top] -= 1
            gap -= top
        lengths, times = np.unique(chosen, return_counts=True)
        more = int((have.left[lengths] // times).min())
        have.left[lengths] -= more * times
        patterns.append(Pattern(tuple(sorted(chosen, reverse=True)), 1 + more))
    return patterns


def _places(patterns: list[Pattern], first_container: int) -> np.ndarray:
    """Rows (length, first rank, container, offset, step): where the items of a length go, by rank.

    A pattern with a length several times fills ranks in turn: item ``rank`` of ``m`` equal ones is
    the ``(rank - first) % m``-th in its container, so one row serves all of them.
    """
    used: dict[int, int] = {}
    rows = []
    container = first_container
    for p in patterns:
        offset = 0
        at = 0
        while at < len(p.lengths):
            length = p.lengths[at]
            m = p.lengths.count(length) if at + 1 < len(p.lengths) and p.lengths[at + 1] == length else 1
            rows.append((length, used.get(length, 0), container, offset, m))
            used[length] = used.get(length, 0) + m * p.copies
            offset += m * length
            at += m
        container += p.copies
    out = np.array(rows, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def _ranked(items: DataFrame, n_items: int) -> DataFrame:
    """``items`` with ``rank``: from 0 within each ``length``, in no order that means anything."""
    salts = max(1, n_items // RANKED_AT_ONCE)
    salted = items.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(salts)))
    per = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("item")) - 1
    return salted.withColumn("within", within).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("within")).drop("salt", "within", "base")


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """item, piece, length, container, offset: where each item (columns ``item``, ``tokens``) goes.

    ``piece`` counts from 1; a piece above 1 exists only for items longer than ``capacity``.
    ``offset`` is the place of the piece's first token in its container. Read ``items`` from a table:
    it is scanned three times.
    """
    tokens = F.coalesce(F.col("tokens"), F.lit(0))
    full = F.floor(tokens / capacity).cast("int")
    rest = (tokens % capacity).cast("int")
    sized = items.select("item", full.alias("full"), rest.alias("length"), tokens.alias("tokens"))
    hist = sized.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full")).collect()  # at most `capacity` rows
    n_full = sum(r["full"] for r in hist)
    n_items = sum(r["n"] for r in hist)
    places = _places(plan({r["length"]: r["n"] for r in hist if r["length"]}, capacity), n_full)
    shared = items.sparkSession.sparkContext.broadcast(places)  # a pattern uses up a length: its size follows the capacity

    @F.pandas_udf("container long, offset int")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table = shared.value
        key = table[:, 0] * (1 << 40) + table[:, 1]
        at = np.searchsorted(key, length.to_numpy(np.int64) * (1 << 40) + rank.to_numpy(np.int64), side="right") - 1
        inside = rank.to_numpy(np.int64) - table[at, 1]
        return pd.DataFrame({"container": table[at, 2] + inside // table[at, 4], "offset": (table[at, 3] + inside % table[at, 4] * length.to_numpy(np.int64)).astype("int32")})

    rests = _ranked(sized.where("length > 0"), n_items).withColumn("at", place("length", "rank"))
    rests = rests.select("item", (F.col("full") + 1).alias("piece"), "length", F.col("at.container").alias("container"), F.col("at.offset").alias("offset"))
    empty = sized.where("tokens = 0").select("item", F.lit(1).alias("piece"), F.lit(0).alias("length"), F.lit(0).cast("long").alias("container"), F.lit(0).alias("offset"))
    whole = _full_pieces(sized.where("full > 0"), n_items)
    return rests.unionByName(empty).unionByName(whole.select("item", "piece", F.lit(capacity).alias("length"), "container", F.lit(0).alias("offset")))


def _full_pieces(items: DataFrame, n_items: int) -> DataFrame:
    """The full pieces of the items that exceed the capacity, numbered through all of them."""
    salts = 64 + n_items // RANKED_AT_ONCE
    salted = items.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(salts)))
    per = salted.groupBy("salt").agg(F.sum("full").alias("n"))
    order = Window.partitionBy(F.lit(0)).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("salt", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))  # one row per salt
    running = Window.partitionBy("salt").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("base") + F.coalesce(F.sum("full").over(running), F.lit(0))
    return salted.join(base, "salt").withColumn("first", first).select("item", F.posexplode(F.sequence(F.lit(1), F.col("full"))).alias("at", "piece"), "first").withColumn("container", F.col("first") + F.col("at"))



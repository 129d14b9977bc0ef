"""All pairs of sets within a Jaccard distance: a metric-space join by recursive Voronoi regions.

Jaccard distance is a metric, so with a pivot ``p`` and a limit ``t`` on the distance a pair within
``t`` has ``|d(x, p) - d(y, p)| <= t`` (the window about a pivot).

A region is split by pivots taken from it. A set's home is the region of its nearest pivot if that
lies within RADIUS, else the region far from all pivots. If ``x`` is at home with ``p``, then ``d(x, p)
<= RADIUS``, and whatever is within ``t`` of it has ``d(y, p) <= RADIUS + t``: so each set is replicated to
all pivots within RADIUS + t, and a pair meets where either is at home. Sets far from all pivots meet
there. Bounding the radius is what makes the regions small: with unbounded ones the window is ``2 t`` about the
nearest distance, which for unrelated texts, at distances close to 1, includes every pivot. A pivot's region
is a family of related sets and is joined exactly, block by block, with the window as a filter; the
sets far from all pivots are split again by pivots of their own until few are left.

Whole texts separate nothing at the first level, where nearly all of them are far from any pivot.
Therefore the first level's pivots are single shingles. The distance to a singleton ``{s}`` is ``1 - 1/|x|``
if ``s`` lies in ``x`` and 1 if not, so all members of ``x`` are equally near pivots, and a pair within ``t`` has a
common member among the first ``|x| - ceil((1 - t)|x|) + 1`` of both in any fixed order. With rare
shingles first, these regions hold little but near-duplicates, whose own members are good pivots.

Every candidate that is met is checked against the full sets. Nothing is sampled, capped or dropped.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.bitmap import only, slots
from tracewright.llm.shingles import flat, most_apart, parities, similarity
from tracewright.sources.scratch import settle

#: Members above which a region is split; pivots of a split at least (the square root of the members, if that is more); levels.
REGION = 16
PIVOTS = 4
LEVELS = 2
#: How far from its pivot a set is at home. Unrelated texts are farther than RADIUS + t from each other.
RADIUS = 0.5
#: Counters of shingles told to all tasks: 2**SLOTS at most, of a byte each, the counts below EXACT as they are.
SLOTS = 25
EXACT = 64
#: Bits of a set's parities.
PARITY = 256
_SLACK = 1e-9


def _counts(sets: DataFrame, bits: int) -> np.ndarray:
    """For each slot of shingles how many sets have one of them: exact below EXACT, then in steps of an eighth of a doubling.

    A shingle's slot counts it and those that share the slot, so a count of 1 says that a single set has it.
    """
    chunk = 1 << min(bits, 18)

    def count(batches):  # noqa: ANN001, ANN202
        table = np.zeros(1 << bits, np.uint16)
        for rows in batches:
            at, n = np.unique(slots(flat(rows["grams"])[0], bits), return_counts=True)
            table[at] = np.minimum(table[at] + n, 65535)
        for i in range(0, len(table), chunk):
            if (part := table[i : i + chunk]).any():
                yield pd.DataFrame({"chunk": [i // chunk], "counts": [zlib.compress(part.tobytes(), 1)]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(chunk, np.int64)
        for part in rows["counts"]:
            total += np.frombuffer(zlib.decompress(part), np.uint16)
        steps = EXACT + np.floor(8 * np.log2(np.maximum(total, EXACT) / EXACT)).astype(np.int64)
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "counts": [zlib.compress(np.where(total < EXACT, total, np.minimum(steps, 255)).astype(np.uint8).tobytes(), 1)]})

    schema = "chunk int, counts binary"
    out = np.zeros(1 << bits, np.uint8)
    for row in sets.select("grams").mapInPandas(count, schema).groupBy("chunk").applyInPandas(add, schema).collect():  # 2**bits bytes at most
        out[row["chunk"] * chunk : (row["chunk"] + 1) * chunk] = np.frombuffer(zlib.decompress(row["counts"]), np.uint8)
    return out


def _seeds(sets: DataFrame, t: float) -> DataFrame:
    """x, n, parity, regions, ranks: for each different set its size, the singletons whose regions it belongs to and their ranks in it.

    Singletons of a single set are left out, as nothing can be met there.
    """
    bits = min(max((256 * sets.count()).bit_length(), 16), SLOTS)
    table = sets.sparkSession.sparkContext.broadcast(_counts(sets, bits))

    def of(batches):  # noqa: ANN001, ANN202
        for rows in batches:
            grams, n = flat(rows["grams"])
            if not len(grams):
                continue
            own = np.repeat(np.arange(len(n)), n)
            often = table.value[slots(grams, bits)]
            order = np.lexsort((grams, often, own))
            rank = np.arange(len(grams)) - np.repeat(np.cumsum(n) - n, n)
            first = n - np.ceil((1 - t) * n - _SLACK).astype(np.int64) + 1
            kept = (rank < first[own]) & (often[order] > 1)
            cuts = np.cumsum(np.bincount(own[kept], minlength=len(n)))[:-1]
            yield pd.DataFrame({"x": rows["x"], "n": n, "parity": list(parities(grams, n, PARITY)), "regions": np.split(grams[order][kept], cuts), "ranks": np.split(rank[kept], cuts)})

    seeds = sets.select("x", "grams").mapInPandas(of, "x long, n int, parity array<long>, regions array<long>, ranks array<int>")
    return settle(seeds.where(F.size("regions") > 0).dropDuplicates(["x"]), "seeds")


def _apart(pivots: DataFrame) -> DataFrame:
    """Pivots (region, p, p_grams) without those within RADIUS of a lesser one: a family of alike sets needs one pivot, not several."""
    a, b = pivots.alias("a"), pivots.select("region", F.col("p").alias("q"), F.col("p_grams").alias("q_grams")).alias("b")
    close = a.join(b, (F.col("a.region") == F.col("b.region")) & (F.col("q") < F.col("p"))).where(similarity(F.col("p_grams"), F.col("q_grams")) >= 1 - RADIUS)
    return pivots.join(close.select("a.region", "p").distinct(), ["region", "p"], "left_anti")


def _split(regions: DataFrame, sets: DataFrame, t: float, level: int) -> DataFrame:
    """Splits regions (region, x, n, rank, at, homes, m) by pivots of their own; ``at`` becomes the distance to the pivot, ``rank`` stays that of the shared shingle.

    Bit ``level`` of ``homes`` tells whether the set is at home in the new region, ``far`` whether that has no pivot.
    """
    members = regions.select("region", "x", "n", "rank", "homes", "m").join(sets.select("x", "grams"), "x")
    # Pivots by least hash, one from each share of the region: combined on the map side.
    pivot = F.struct(F.col("x").alias("p"), F.col("grams").alias("p_grams"))
    shares = F.greatest(F.lit(PIVOTS), F.ceil(F.sqrt("m")))
    pivots = members.groupBy("region", F.pmod(F.xxhash64(F.lit(5), "x"), shares).alias("share")).agg(F.min_by(pivot, F.xxhash64("region", "x")).alias("pivot"))
    pivots = _apart(settle(pivots.select("region", "pivot.p", "pivot.p_grams"), "pivots"))
    near = members.join(pivots, "region").select("region", "x", "n", "rank", "homes", "p", (1 - similarity(F.col("grams"), F.col("p_grams"))).alias("d"))
    entry = F.struct("d", "p")
    seen = near.groupBy("region", "x").agg(
        *[F.any_value(c).alias(c) for c in ("n", "rank", "homes")],
        F.min(F.when(F.col("d") <= RADIUS, entry)).alias("home"),
        F.collect_list(F.when(F.col("d") <= RADIUS + t + _SLACK, entry)).alias("reach"),  # as many as there are pivots, at most
    )
    far = F.when(F.col("home").isNull(), F.array(F.struct(F.lit(0.0).alias("d"), F.lit(None).cast("long").alias("p"))))
    placed = seen.withColumn("to", F.explode(F.concat("reach", F.coalesce(far, F.array().cast("array<struct<d:double,p:bigint>>")))))
    at_home = F.col("to.p").eqNullSafe(F.col("home.p"))
    return placed.select(
        F.xxhash64(F.lit(level), "region", F.coalesce("to.p", F.lit(-1))).alias("region"),
        F.col("to.p").isNull().alias("far"),
        "x",
        "n",
        "rank",
        F.col("to.d").alias("at"),
        F.col("homes").bitwiseOR(F.when(at_home, F.lit(1 << level)).otherwise(F.lit(0))).alias("homes"),
    )


def _sized(regions: DataFrame) -> DataFrame:
    """Regions with their number of members as ``m``; those with one member cannot hold a pair."""
    return regions.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("region"))).where("m > 1")


def _blocks(regions: DataFrame) -> DataFrame:
    """Rows of regions for each pair of blocks (i <= j) that they take part in; blocks hold REGION members on average."""
    blocks = F.ceil(F.col("m") / REGION).cast("int")
    own = F.pmod(F.xxhash64(F.lit(3), "x"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cut = regions.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", other)
    return cut.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))


def _meet(regions: DataFrame, t: float, near: Column, levels: int = 0) -> DataFrame:
    """Candidate pairs (a < b) of regions split ``levels`` times that pass the size window and ``near``; on each level one of them is at home."""
    rows = _blocks(regions).select("region", "i", "j", "own", "x", "n", "rank", "at", "homes")
    a, b = rows.alias("a"), rows.alias("b")
    same = (F.col("a.region") == F.col("b.region")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    # Of two blocks each pair is met once: the first from block i, the second from block j.
    turn = (F.col("a.own") == F.col("a.i")) & (F.col("b.own") == F.col("b.j")) & ((F.col("a.i") != F.col("a.j")) | (F.col("a.x") < F.col("b.x")))
    size = F.least("a.n", "b.n") >= (1 - t) * F.greatest("a.n", "b.n") - _SLACK
    home = F.col("a.homes").bitwiseOR(F.col("b.homes")) == (1 << levels) - 1
    met = a.join(b, same & turn & size & home & near)
    return met.select(F.least("a.x", "b.x").alias("a"), F.greatest("a.x", "b.x").alias("b"))


def similar_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity: all pairs a < b of different sets whose Jaccard similarity is ``threshold`` or more.

    ``sets``: x (a number that tells the set), grams (a sorted array without repeats); a set may stand there several
    times. Empty sets are in no pair. ``sets`` is scanned several times: read it, or the texts that it is made of, from a table.
    """
    t = 1 - threshold
    seeds = _seeds(sets, t)
    # Members that only one has at most, and those that are common to both at least.
    apart = most_apart(F.col("a.n") + F.col("b.n"), threshold)
    common = (F.col("a.n") + F.col("b.n") - apart) / 2
    # Where the shared shingle is the first that is: what ranks before it is not common, and enough must follow.
    by_rank = (F.least(F.col("a.n") - F.col("a.rank"), F.col("b.n") - F.col("b.rank")) >= common) & (F.col("a.rank") + F.col("b.rank") <= apart)
    window = F.abs(F.col("a.at") - F.col("b.at")) <= t + _SLACK

    entries = seeds.select("x", "n", F.explode(F.arrays_zip("regions", "ranks")).alias("e")).select(F.col("e.regions").alias("region"), "x", "n", F.col("e.ranks").alias("rank"))
    regions = settle(_sized(entries), "regions").withColumns({"homes": F.lit(0), "at": F.lit(0.0)})
    met = _meet(regions.where(F.col("m") <= REGION), t, by_rank)
    large = regions.where(F.col("m") > REGION)
    if not large.isEmpty():
        inside = only(sets, large)
    for level in range(LEVELS):
        if large.isEmpty():
            break
        parts = settle(_sized(settle(_split(large, inside, t, level), f"split-{level}")), f"regions-{level}")
        again = F.col("far") & (F.col("m") > REGION) if level < LEVELS - 1 else F.lit(False)
        met = met.unionByName(_meet(parts.where(~again), t, by_rank & window, level + 1))
        large = parts.where(again)
    # Sets that differ in more parities than alike ones may in members are not alike.
    side = lambda c: seeds.select(F.col("x").alias(c), F.struct("n", "parity").alias(f"{c}_side"))
    both = met.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", F.col("a_side").alias("u"), F.col("b_side").alias("v"))
    odd = sum((F.bit_count(F.col("u.parity")[i].bitwiseXOR(F.col("v.parity")[i])) for i in range(PARITY // 64)), F.lit(0))
    total = F.col("u.n") + F.col("v.n")
    met = settle(both.where(odd <= most_apart(total, threshold)).select("a", "b"), "met")
    known = only(sets, met.select(F.explode(F.array("a", "b")).alias("x"))).dropDuplicates(["x"])
    left = met.join(known.select(F.col("x").alias("a"), F.col("grams").alias("a_grams")), "a")
    both = left.join(known.select(F.col("x").alias("b"), F.col("grams").alias("b_grams")), "b")
    return both.select("a", "b", similarity(F.col("a_grams"), F.col("b_grams")).alias("similarity")).where(F.col("similarity") >= threshold - _SLACK)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """x, component: the least node that each of ``nodes`` (x) is linked to through ``edges`` (a, b).

    Alternates two steps that combine on the map side until the links no longer change: every node's
    greater neighbours are linked to its least neighbour, then its lesser ones.
    """
    links = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        links = settle(small.where("u <> v").distinct(), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return nodes.join(links.select(F.col("u").alias("x"), F.col("v").alias("component")), "x", "left").select("x", F.coalesce("component", "x").alias("component"))

"""Mixing sources to target weights by temperature, drawn as budgeted block permutations.

Weights lie on the family ``w(a) ~ natural**(1 - a) * target**a``; with equal targets this is temperature
sampling, which exponentiates the sources' token shares by ``1 - a``. ``a`` is bisected to
the largest value, 1 at most, at which no source's budget exceeds its tokens times its repetition
limit; or to the value at which the weights have a wanted entropy.

A source's budget is spent in passes over all of its documents; the last pass is partial. Documents
lie in blocks by a hash; the partial pass takes the blocks in an order of its own,
and only the blocks about the budget's end are counted document by document (those that still fit
are taken). Blocks
hold a bounded number of documents on average, so a source with a third of all documents is spread
as evenly as any other.

Cases with a defined result: sources match without case and outer blanks; documents of sources
without a target, and documents without tokens, are not drawn; a source with a target but no
documents gets nothing and the others are scaled to the target shares among themselves; repeated
rows count as documents of their own if their id differs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Documents of a block, on average, and blocks whose sums are added up in one window.
DOCUMENTS_PER_BLOCK = 64
BLOCKS_PER_GROUP = 1024
#: Blocks from which the end of a budget is filled document by document.
LAST_BLOCKS = 16
_STEPS = 100


@dataclass(frozen=True)
class Source:
    """What a source offers and what is wanted of it."""

    name: str
    tokens: int
    documents: int
    target: float
    max_repeats: int


def weights(sources: list[Source], exponent: float) -> list[float]:
    """The members' weights at an exponent between 0 (natural) and 1 (target)."""
    total = sum(s.tokens for s in sources)
    logs = [(1 - exponent) * math.log(s.tokens / total) + exponent * math.log(s.target) for s in sources]
    top = max(logs)
    raw = [math.exp(x - top) for x in logs]
    return [x / sum(raw) for x in raw]


def entropy(w: list[float]) -> float:
    """Entropy of weights, in nats."""
    return -sum(x * math.log(x) for x in w if x > 0)


def _bisect(ok, low: float = 0.0, high: float = 1.0) -> float:  # noqa: ANN001
    """The largest exponent at which ``ok`` holds, if it holds up to some point; 0 if nowhere."""
    if ok(high):
        return high
    for _ in range(_STEPS):
        mid = (low + high) / 2
        low, high = (mid, high) if ok(mid) else (low, mid)
    return low


def within_repeats(sources: list[Source], exponent: float, budget: float) -> bool:
    """Whether no source is asked for more than its repetition limit allows."""
    return all(w * budget <= s.tokens * s.max_repeats * (1 + 1e-12) for w, s in zip(weights(sources, exponent), sources, strict=True))


def largest_budget(sources: list[Source]) -> int:
    """The most tokens that can be drawn with exactly the target weights."""
    if not sources:
        return 0
    w = weights(sources, 1.0)
    return math.floor(min(s.tokens * s.max_repeats / x for s, x in zip(sources, w, strict=True)))


def solve(sources: list[Source], budget: int, target_entropy: float | None = None) -> tuple[float, list[float]]:
    """The exponent and the weights for a budget; see the module's head."""

    if not sources:
        return 1.0, []

    def ok(a: float) -> bool:
        if not within_repeats(sources, a, budget):
            return False
        return target_entropy is None or (entropy(weights(sources, a)) - target_entropy) * (1 if entropy(weights(sources, 1.0)) > entropy(weights(sources, 0.0)) else -1) <= 0

    a = _bisect(ok)
    return a, weights(sources, a)


def offered(sizes: DataFrame, targets: DataFrame) -> list[Source]:
    """The sources with a target and at least one token. ``sizes``: source, tokens. A row per target comes to the driver."""
    have = sizes.groupBy("source").agg(F.sum(F.col("tokens").cast("long")).alias("tokens"), F.count(F.when(F.col("tokens") > 0, 1)).alias("documents"))
    wanted = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats")
    rows = wanted.join(have, "source").where("tokens > 0 and target_share > 0 and max_repeats > 0").orderBy("source").collect()
    total = sum(r["target_share"] for r in rows)
    return [Source(r["source"], r["tokens"], r["documents"], r["target_share"] / total, r["max_repeats"]) for r in rows]


def draw(sizes: DataFrame, sources: list[Source], budgets: list[int], seed: int = 0) -> DataFrame:
    """doc_id, source, use, tokens, position: the documents drawn (``use`` from 1), each source up to its budget.

    ``sizes`` has doc_id, source, tokens; read it from a table, as it is scanned twice. ``position`` is
    a hash that orders the mixture: sorting by it interleaves the sources.
    """
    spark = sizes.sparkSession
    plan = spark.createDataFrame(
        [
            (s.name, n := max(1, s.documents // DOCUMENTS_PER_BLOCK), b // s.tokens, b % s.tokens, LAST_BLOCKS * s.tokens // n)
            for s, b in zip(sources, budgets, strict=True)
        ],
        "source string, blocks long, full long, rest long, beyond long",
    )
    docs = sizes.where("tokens > 0").join(F.broadcast(plan), "source")  # the plan has a row per target source
    docs = docs.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), "blocks"))
    passes = docs.where("full > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1).cast("long"), "full")).alias("use"), "tokens")

    # The partial pass: blocks in a hash's order, their sums added up within groups and then over the groups.
    blocks = docs.groupBy("source", "block", "blocks", "rest").agg(F.sum("tokens").alias("n"))
    turn = F.xxhash64(F.lit(seed), F.lit("turn"), F.col("source"), F.col("block"), F.col("blocks"))
    groups = F.greatest(F.lit(1), F.col("blocks") / BLOCKS_PER_GROUP).cast("long")
    # The turn's high bits tell the group, so that groups follow each other in the turn's order.
    ranked = blocks.withColumn("turn", turn).withColumn("group", F.floor((F.shiftrightunsigned("turn", 12) / F.lit(float(2**52))) * groups))
    sums = ranked.groupBy("source", "group").agg(F.sum("n").alias("n"))
    over_groups = Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("source", "group", F.coalesce(F.sum("n").over(over_groups), F.lit(0)).alias("base"))
    over_blocks = Window.partitionBy("source", "group").orderBy(F.shiftrightunsigned("turn", 1), "block").rowsBetween(Window.unboundedPreceding, -1)
    began = (
        ranked.withColumn("inner", F.coalesce(F.sum("n").over(over_blocks), F.lit(0)))
        .join(base, ["source", "group"])
        .select("source", "block", (F.col("base") + F.col("inner")).alias("began"), "n")
    )
    partial = docs.join(began.withColumnRenamed("n", "block_tokens"), ["source", "block"]).where("rest > 0 and began < rest + beyond")
    inside = F.col("began") + F.col("block_tokens") <= F.col("rest")
    whole = partial.where(inside)
    last = partial.where(~inside).select("doc_id", "source", (F.col("full") + 1).alias("use"), "tokens", "began", "rest")
    last = last.groupBy("source").applyInPandas(_fill, last.drop("began", "rest").schema)  # LAST_BLOCKS of each source
    tail = whole.select("doc_id", "source", (F.col("full") + 1).alias("use"), "tokens").unionByName(last)
    drawn = passes.unionByName(tail)
    return drawn.withColumn("use", F.col("use").cast("int")).withColumn("position", F.xxhash64(F.lit(seed), F.lit("mix"), "doc_id", "use"))


def _fill(last: pd.DataFrame) -> pd.DataFrame:
    """Takes a source's last documents in turn, passing over those that exceed what is left of the budget."""
    last = last.sort_values(["began", "doc_id"])
    left = int(last["rest"].iloc[0] - last["began"].iloc[0])
    taken = []
    for n in last["tokens"]:
        taken.append(n <= left)
        left -= n if taken[-1] else 0
    return last.loc[taken].drop(columns=["began", "rest"])


def shares(drawn: DataFrame, sources: list[Source], exponent: float) -> DataFrame:
    """source, documents, uses, tokens, share, target_share, exponent: what the draw reached."""
    spark = drawn.sparkSession
    wanted = spark.createDataFrame([(s.name, s.target, s.max_repeats) for s in sources], "source string, target_share double, max_repeats int")
    got = drawn.groupBy("source").agg(F.count(F.lit(1)).alias("uses"), F.max("use").alias("most_uses"), F.sum(F.col("tokens").cast("long")).alias("tokens"))
    total = got.agg(F.sum("tokens").alias("total"))
    return got.join(F.broadcast(wanted), "source").crossJoin(F.broadcast(total)).select("source", "uses", "most_uses", "max_repeats", "tokens", (F.col("tokens") / F.col("total")).alias("share"), "target_share", F.lit(exponent).alias("exponent"))

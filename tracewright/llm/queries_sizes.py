"""Queries of the operators that go by token counts: containers, mixtures, pieces."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import mixing, packing, splitting
from tracewright.llm.tokens import token_count, vocabulary_path
from tracewright.sources.scratch import settle, spread
from tracewright.sources.tables import load


def document_sizes(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source, tokens of every document, written once: the texts are tokenized only here."""
    docs = spread(load(spark, d, "documents").select("doc_id", "source", "text"))
    source = F.lower(F.trim("source")).alias("source")
    return settle(docs.select("doc_id", source, token_count(vocabulary_path())("text").alias("tokens")), "document-sizes")


def _limits(spark: SparkSession, d: str, purpose: str) -> list:
    return load(spark, d, "size_limits").where(F.col("purpose") == purpose).orderBy("limit_id").collect()  # a row per limit


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """limit_id, doc_id, piece, n_tokens, container, start: every document's place, for each container size."""
    sizes = document_sizes(spark, d).select(F.col("doc_id").alias("item"), "tokens")
    out = None
    for limit in _limits(spark, d, "container"):
        packed = packing.pack(sizes, limit["max_tokens"]).select(
            F.lit(limit["limit_id"]).alias("limit_id"),
            F.col("item").alias("doc_id"),
            "piece",
            F.col("length").alias("n_tokens"),
            "container",
            F.col("offset").alias("start"),
        )
        out = packed if out is None else out.unionByName(packed)
    return out


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """limit_id, containers, used_share: how full the containers are."""
    placed = p7_containers(spark, d)
    limits = load(spark, d, "size_limits").select("limit_id", "max_tokens")
    per = placed.groupBy("limit_id", "container").agg(F.sum("n_tokens").alias("used"))
    total = per.groupBy("limit_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("used"))
    return total.join(limits, "limit_id").select("limit_id", "containers", (F.col("used") / (F.col("containers") * F.col("max_tokens"))).alias("used_share"))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, list[mixing.Source], float]:
    sizes = document_sizes(spark, d)
    sources = mixing.offered(sizes, load(spark, d, "mix_targets"))
    budget = mixing.largest_budget(sources)
    exponent, w = mixing.solve(sources, budget)
    return mixing.draw(sizes, sources, [round(x * budget) for x in w]), sources, exponent


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source, use, tokens, position: the largest mixture that has the target shares."""
    return _mixture(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mixture reaches, beside the targets."""
    return mixing.shares(*_mixture(spark, d))


def p8_tempered(spark: SparkSession, d: str) -> DataFrame:
    """goal and the shares reached, with the exponent that was bisected, for two goals that target shares alone cannot meet.

    ``total``: as many tokens as the sources hold, the exponent as near to the target shares as their
    repetition limits let it be. ``entropy``: source token shares, exponentiated until they are as mixed
    as the targets, for half of the tokens the sources hold.
    """
    sizes = document_sizes(spark, d)
    sources = mixing.offered(sizes, load(spark, d, "mix_targets"))
    held = sum(s.tokens for s in sources)
    flat = [dataclasses.replace(s, target=1 / len(sources)) for s in sources]
    goals = [("total", sources, held, None), ("entropy", flat, held // 2, mixing.entropy([s.target for s in sources]))]
    out = None
    for goal, wanted, budget, entropy in goals:
        exponent, w = mixing.solve(wanted, budget, entropy)
        drawn = mixing.draw(sizes, wanted, [round(x * budget) for x in w])
        got = mixing.shares(drawn, sources, exponent).withColumn("goal", F.lit(goal))
        out = got if out is None else out.unionByName(got)
    return out


def _pieces(spark: SparkSession, d: str, limits: list) -> DataFrame:
    docs = spread(load(spark, d, "documents").select("doc_id", "text"))
    return splitting.split_texts(docs, [(r["limit_id"], r["max_tokens"], r["overlap_tokens"]) for r in limits], vocabulary_path())


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    """limit_id, doc_id, piece, ...: the pieces of every document, for each piece size; texts are read once."""
    return _pieces(spark, d, _limits(spark, d, "piece"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that limit 4 makes the splitter cut."""
    return _pieces(spark, d, load(spark, d, "size_limits").where("limit_id = 4").collect()).where("piece = 2").select("doc_id")


QUERIES = {
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p8_tempered": p8_tempered,
    "p9_found": p9_found,
    "p9_pieces": p9_pieces,
}
SQL: dict[str, str] = {}

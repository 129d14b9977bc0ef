"""Past fixes that resemble an error, by seven signals, with one fix for each kind of trouble.

Errors are queries against all fixes. What must only lie within a text (addresses, codes, types) is
looked up once for each different value (``needles_in``). After that whatever an error and a fix can share is equal
on both sides: a number for each word, tag, address, code or type. Scores of pairs are added up in memory, a block of
errors against a block of fixes, and only the best of a block leave it: pairs are neither shuffled nor stored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.functions.fields import comma_tags
from tracewright.operators.search import keywords, needles_in
from tracewright.sources.scratch import settle

#: Weights of the signals, the least score, and how many fixes are shown.
WEIGHTS = {"address": 25, "code": 20, "words": 15, "type": 8, "tag": 5, "issue_word": 2, "resolution_word": 1}
LEAST, SHOWN = 15, 5
#: Patterns of addresses, types and codes, and names of common errors.
ADDRESS = r"(?i)((?:aws|azurerm|google)_\w+\.\w+)"
TYPES = r"(?i)((?:aws|azurerm|google)_\w+)"
CODE_FORMS = ["(?i)code[:\\s]*[\"']?(\\w+)[\"']?", r"\b(4\d{2}|5\d{2})\b", r"(?i)error:\s+(\w+(?:\.\w+)*)", r"(?i)<code>(\w+)</code>", r"(?i)statuscode[=:]?\s*(\d+)", r"(?i)api error (\w+(?:\.\w+)*)"]
ERROR_NAMES = "accessdenied authorizationfailed forbidden unauthorized notfound timeout connectionrefused permissiondenied invalidrequest quotaexceeded throttled conflict".split()


def _all(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lower)


def error_codes(text: Column) -> Column:
    """The different error codes that a text (in lower case) names, by all rules."""
    named = F.array_compact(F.array(*[F.when(text.contains(n), F.lit(n)) for n in ERROR_NAMES]))
    return F.array_distinct(F.concat(*[_all(text, p) for p in CODE_FORMS], named))


def named_types(text: Column) -> Column:
    """The different resource types that a text names."""
    return F.array_distinct(_all(text, TYPES))


def named_addresses(text: Column) -> Column:
    """The different addresses (type and name) that a text names."""
    return F.array_distinct(_all(text, ADDRESS))


def trouble(fixes: DataFrame) -> Column:
    """What makes two fixes the same kind of trouble: types, codes, and the first three words of the issue."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    types = F.array_sort(named_types(F.concat_ws(" ", filled("tags"), filled("error_excerpt"))))
    codes = F.array_sort(error_codes(F.lower(F.coalesce("error_excerpt", F.lit("")))))
    words = F.slice(F.array_sort(keywords(F.coalesce("issue", F.lit("")))), 1, 3)
    return F.concat_ws("||", F.array_join(types, "|"), F.array_join(codes, "|"), F.array_join(words, "|"))


#: Fixes and errors that are scored against each other in memory at once.
FIX_BLOCK, ERROR_BLOCK = 8192, 16384
#: A fix's value for what it shares: one word of the common ones times WORD, plus points.
WORD = 1 << 32


def _number(family: str, value: Column) -> Column:
    """What tells a value of a family; different ones differ but for a chance of 2**-64."""
    return F.xxhash64(F.concat(F.lit(f"{family}:"), value))


def _numbers(family: str, values: Column) -> Column:
    return F.transform(values, lambda v: _number(family, v))


def _features(errors: DataFrame, fixes: DataFrame, weights: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """query, n, parts of every error and seq, n, parts, worth, kind of every fix: the numbers of what they may share, and what each is worth."""
    low = F.lower(F.coalesce("text", F.lit("")))
    plain = lambda tags: F.filter(comma_tags(tags), lambda t: ~t.rlike(f"^{TYPES[4:]}$"))
    addresses = F.array_distinct(F.array_compact(F.concat(F.array(F.lower(F.nullif("address", F.lit("")))), named_addresses(low))))
    q = errors.select("query", keywords(F.coalesce("text", F.lit(""))).alias("words"), addresses.alias("addresses"), named_types(low).alias("types"), error_codes(low).alias("codes"), plain(F.col("tags")).alias("tags"))
    q = settle(q, "errors")
    families = [("word", "words"), ("tag", "tags"), ("address", "addresses"), ("code in excerpt", "codes"), ("code in issue", "codes"), ("type", "types")]
    asked = q.select("query", F.size("words").alias("n"), F.concat(*[_numbers(family, F.col(c)) for family, c in families]).alias("parts"))

    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    f = fixes.select("seq", "issue", "error_excerpt", "tags", keywords(F.concat_ws(" ", filled("error_excerpt"), filled("issue"))).alias("w"), keywords(F.coalesce("issue", F.lit(""))).alias("wi"), keywords(F.coalesce("resolution", F.lit(""))).alias("wr"), trouble(fixes).alias("kind"))
    every = F.concat_ws(" ", filled("issue"), filled("error_excerpt"), filled("tags"))
    within = None
    for family, values, text, weight in (("address", "addresses", every, "address"), ("code in excerpt", "codes", F.col("error_excerpt"), "code"), ("code in issue", "codes", F.col("issue"), "code"), ("type", "types", F.col("tags"), "type")):
        met = needles_in(q.select(F.explode(values).alias("needle")), fixes.select("seq", F.lower(text).alias("t")))
        met = met.select("seq", F.struct(_number(family, F.col("needle")).alias("part"), F.lit(weights[weight]).cast("long").alias("worth")).alias("m"))
        within = met if within is None else within.unionByName(met)
    within = within.groupBy("seq").agg(F.collect_list("m").alias("within"))
    worth = lambda x: F.when(F.array_contains("w", x), F.lit(WORD)).otherwise(F.lit(0)) + F.when(F.array_contains("wi", x), weights["issue_word"]).otherwise(0) + F.when(F.array_contains("wr", x), weights["resolution_word"]).otherwise(0)
    own = F.concat(
        F.transform(F.array_union(F.array_union("w", "wi"), "wr"), lambda x: F.struct(_number("word", x).alias("part"), worth(x).cast("long").alias("worth"))),
        F.transform(plain(F.col("tags")), lambda t: F.struct(_number("tag", t).alias("part"), F.lit(weights["tag"]).cast("long").alias("worth"))),
    )
    both = f.select("seq", "kind", F.size("w").alias("n"), own.alias("own")).join(within, "seq", "left")
    all_ = F.concat("own", F.coalesce("within", F.array().cast("array<struct<part:bigint,worth:bigint>>")))
    return asked, both.select("seq", "kind", "n", F.transform(all_, lambda m: m["part"]).alias("parts"), F.transform(all_, lambda m: m["worth"]).alias("worth"))


def _flat(arrays: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The members of all arrays, and the position of the array that each is from."""
    sizes = np.fromiter(map(len, arrays), np.int64, len(arrays))
    members = np.concatenate(arrays.to_list()).astype(np.int64) if sizes.sum() else np.empty(0, np.int64)
    return members, np.repeat(np.arange(len(arrays)), sizes)


def _best_of_block(errors: pd.DataFrame, fixes: pd.DataFrame, most: int, least: int, word_weight: int) -> pd.DataFrame:
    """query, seq, score, kind: for each error the best fix of each of its ``most`` best kinds of trouble in a block."""
    fixes = fixes.sort_values("seq", ignore_index=True)
    seqs, n, kinds = fixes["seq"].to_numpy(), fixes["n"].to_numpy(), fixes["kind"].to_numpy()
    kind = pd.factorize(kinds)[0]
    parts, rows = _flat(fixes["parts"])
    worth = _flat(fixes["worth"])[0]
    order = np.argsort(parts, kind="stable")
    parts, rows, worth = parts[order], rows[order], worth[order]
    asked, asker = _flat(errors["parts"])
    begin, end = np.searchsorted(parts, asked, "left"), np.searchsorted(parts, asked, "right")
    first = np.searchsorted(asker, np.arange(len(errors) + 1))
    turn = np.arange(len(fixes), dtype=np.int64)
    out = []
    for i, (query, words) in enumerate(zip(errors["query"].to_numpy(), errors["n"].to_numpy(), strict=True)):
        acc = np.zeros(len(fixes), np.int64)
        for k in range(first[i], first[i + 1]):
            b, e = begin[k], end[k]
            if b < e:
                acc[rows[b:e]] += worth[b:e]  # a fix has each part once
        shared = acc >> 32
        score = (acc & (WORD - 1)) + np.floor(shared / np.maximum(words + n - shared, 1) * word_weight).astype(np.int64)
        found = np.flatnonzero((acc > 0) & (score >= least))
        place = -score[found] * len(turn) + turn[found]  # best first, then storage order
        few = 16 * most
        while True:
            near = np.argpartition(place, few)[:few] if few < len(place) else np.arange(len(place))
            near = found[near[np.argsort(place[near])]]
            ones = near[np.sort(np.unique(kind[near], return_index=True)[1])[:most]]
            if len(ones) == most or few >= len(place):
                break
            few *= 8
        out += [(query, seqs[j], score[j], kinds[j]) for j in ones]
    return pd.DataFrame(out, columns=["query", "seq", "score", "kind"])


def similar_fixes(errors: DataFrame, fixes: DataFrame, most: int = SHOWN, least: int = LEAST, weights: dict[str, int] = WEIGHTS) -> DataFrame:
    """query, place, seq, score: the fixes most like each error; of fixes with the same kind of trouble the best counts, of equals the first.

    ``errors``: query, text, tags, address (each may be null); ``fixes``: seq, issue, resolution,
    error_excerpt, tags. A code counts for the excerpt and again for the issue. A kind that is not among the best of
    the block where its best fix is has as many better ones there, so the best of all blocks are the best of all fixes.
    """
    spark = fixes.sparkSession
    asked, known = _features(errors, fixes, weights)
    asked, known = settle(asked, "asked"), settle(known, "known")
    n_fixes, n_errors = known.count(), asked.count()
    blocks = max(1, math.ceil(n_fixes / FIX_BLOCK), min(spark.sparkContext.defaultParallelism, n_fixes // 512))
    groups = max(1, math.ceil(n_errors / ERROR_BLOCK))
    spread_over = lambda c, many: F.pmod(F.xxhash64(c), F.lit(many)).cast("int")
    to_all = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    left = asked.withColumn("group", spread_over("query", groups)).withColumn("block", to_all(blocks))
    right = known.withColumn("block", spread_over("seq", blocks)).withColumn("group", to_all(groups))

    def judge(some: pd.DataFrame, against: pd.DataFrame) -> pd.DataFrame:
        return _best_of_block(some, against, most, least, weights["words"])

    best = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInPandas(judge, "query long, seq long, score long, kind string")
    first = F.max(F.struct("score", (-F.col("seq")).alias("back")))
    best = best.groupBy("query", "kind").agg(first.alias("b")).select("query", F.col("b.score").alias("score"), (-F.col("b.back")).alias("seq"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "seq"))
    return best.withColumn("place", place).where(F.col("place") <= most).select("query", "place", "seq", "score")

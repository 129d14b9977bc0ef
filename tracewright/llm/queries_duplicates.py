"""Queries of the duplicate operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.text import strip
from tracewright.llm.history import History
from tracewright.llm.metric_join import components, similar_pairs
from tracewright.llm.shingles import distinct_sets, set_id, shingles
from tracewright.operators.current import current_rows
from tracewright.operators.tags import split_packed
from tracewright.sources.scratch import settle, spread
from tracewright.sources.tables import load

#: As TESTDATA.md states them for fixes: words of a shingle and least similarity.
WORDS, THRESHOLD = 3, 0.7
#: Import batches that a backfill judges in one run, at least; it takes more until it has as many tickets as came before, so
#: the runs, each of which reads the index, grow in number as the logarithm of the batches. Turns order the records across
#: batches, so the rows do not depend on it. A batch that arrives alone is a run of its own.
RUN_BATCHES = 25


def _linked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """id, x, n of the current row of every fix (fixes with the same set have the same x), and the pairs of different sets that are alike.

    What is stored is the texts: their sets take several times as much, and are made again wherever they are read.
    """
    fixes = current_rows(load(spark, d, "fixes"), ["id", "issue", "resolution", "error_excerpt"])
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("issue", "resolution", "error_excerpt")])
    grams = shingles(WORDS)("text")
    texts = settle(fixes.select("id", text.alias("text")).select("id", "text", set_id(grams).alias("x"), F.size(grams).alias("n")), "fix-texts")
    return texts.select("id", "x", "n"), similar_pairs(texts.where("n > 0").select("x", grams.alias("grams")), THRESHOLD)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of fixes that are alike; copies have the same set and are expanded here."""
    fixes, pairs = _linked(spark, d)
    members = fixes.where("n > 0").select("id", "x")
    other = members.select(F.col("id").alias("other"), "x")
    copies = members.join(other, "x").where("id < other").select(F.col("id").alias("id_a"), F.col("other").alias("id_b"))
    left = pairs.select(F.col("a").alias("x"), "b").join(members, "x").select("id", F.col("b").alias("x"))
    across = left.join(other, "x").select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"))
    return copies.unionByName(across)  # an id has one set, so no pair is met twice


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """id, group_id, links: the group of every fix, and to how many different texts it is linked."""
    fixes, pairs = _linked(spark, d)
    pairs = settle(pairs, "pairs")
    groups = components(fixes.select("x").distinct(), pairs)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("x"))
    links = ends.groupBy("x").agg(F.count(F.lit(1)).alias("links"))
    named = fixes.join(groups, "x").join(links, "x", "left")
    least = named.groupBy("component").agg(F.min("id").alias("group_id"))
    return named.join(least, "component").select("id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))


def _text(issue: Column, resolution: Column) -> Column:
    """What is compared of a ticket or fix: markup becomes a blank."""
    return F.regexp_replace(F.concat(issue, F.lit(" "), resolution), r"(?s)<.*?>", " ")


def _filled(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def _source_key(system: Column, key: Column) -> Column:
    """The form in which a ticket's key and a fix's ``source:`` tag meet; null where the key is null or blank."""
    return F.when(_filled(key), F.lower(F.concat(F.lit("source:"), F.trim(system), F.lit(":"), strip(key))))


def _runs(batches: list[tuple[int, int]], before: int) -> list[tuple[int, int]]:
    """First and last batch of each run of ``batches`` (number, tickets); ``before``: what was taken in before them."""
    out: list[tuple[int, int]] = []
    some: list[int] = []
    tickets = 0
    for batch, n in batches:
        some.append(batch)
        tickets += n
        if len(some) >= RUN_BATCHES and tickets >= before:
            out.append((some[0], some[-1]))
            before, some, tickets = before + tickets, [], 0
    return out + ([(some[0], some[-1])] if some else [])


def _judged(spark: SparkSession, d: str, run_batches: int | None = None) -> DataFrame:
    """import_id, batch_no, is_repeat (null: a bad row): the tickets, run by run, against all before them.

    ``run_batches``: how many batches make a run, if not left to what came before.
    """
    fixes = current_rows(load(spark, d, "fixes"), ["issue", "resolution", "tags"])
    fix_sets = fixes.select(shingles(WORDS)(_text(F.col("issue"), F.col("resolution"))).alias("grams"))
    tags = fixes.where(F.lower("tags").contains("source:")).select(F.explode(split_packed("tags")).alias("key"))
    history = History(spark)
    history.seed(distinct_sets(fix_sets, "grams").withColumnRenamed("set_id", "x"), tags.select(F.lower("key").alias("key")).where("key like 'source:%'"))

    tickets = spread(load(spark, d, "ticket_imports"))
    good = tickets.where(_filled(F.col("issue")) & _filled(F.col("resolution")))
    records = good.select(
        F.col("import_id").alias("record"),
        "batch_no",
        _source_key(F.col("source_system"), F.col("source_key")).alias("key"),
        shingles(WORDS)(_text(F.col("issue"), F.col("resolution"))).alias("grams"),
    )
    batches = sorted((r["batch_no"], r["n"]) for r in tickets.where("batch_no is not null").groupBy("batch_no").agg(F.count(F.lit(1)).alias("n")).collect())  # a row per batch
    if run_batches is None:
        runs = _runs(batches, history.sets().count())
    else:
        runs = [(some[0][0], some[-1][0]) for i in range(0, len(batches), run_batches) if (some := batches[i : i + run_batches])]
    out = None
    for first, last in runs:
        some = records.where(F.col("batch_no").between(first, last))
        # Batches come one after another; within one the import id tells the order.
        turn = F.col("batch_no").cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") + F.col("record")
        judged = history.run(some.withColumn("turn", turn).select("record", "turn", "key", "grams"), THRESHOLD)
        out = judged if out is None else out.unionByName(judged)
    none = spark.createDataFrame([], "record long, is_repeat boolean")
    out = none if out is None else out
    return tickets.select("import_id", "batch_no").join(out.withColumnRenamed("record", "import_id"), "import_id", "left")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The tickets that repeat a fix or an earlier ticket."""
    return _judged(spark, d).where("is_repeat").select("import_id", "batch_no")


def p6_batches(spark: SparkSession, d: str) -> DataFrame:
    """batch_no, imported, duplicates, bad_rows: the counters of each batch."""
    count = lambda c: F.count(F.when(c, 1))
    repeat = F.col("is_repeat")
    return _judged(spark, d).groupBy("batch_no").agg(count(~repeat).alias("imported"), count(repeat).alias("duplicates"), count(repeat.isNull()).alias("bad_rows"))


QUERIES = {"p6_found": p6_found, "p6_batches": p6_batches, "p4_found": p4_found, "p4_groups": p4_groups}
_AT = "epoch_us(TRY_CAST(CASE WHEN regexp_matches(trim(updated_at),'(Z|[+-][0-9]{2}:[0-9]{2})$') THEN trim(updated_at) ELSE trim(updated_at)||'Z' END AS TIMESTAMPTZ))"
SQL = {
    "p4_found": f"""
        WITH f AS (SELECT * FROM fixes QUALIFY row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY coalesce({_AT}, -9223372036854775807) DESC, seq DESC) = 1),
        t AS (SELECT id, regexp_extract_all(lower(concat_ws(' ', issue, resolution, coalesce(error_excerpt, ''))), '[a-z0-9]+') AS w FROM f),
        s AS (SELECT id, CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM t WHERE len(w) > 0),
        e AS (SELECT id, len(g) AS n, unnest(g) AS x FROM s),
        m AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2)
        SELECT id_a, id_b FROM m WHERE 10 * c >= 7 * (na + nb - c)"""
}

"""The state of deferred errors: versions, sessions, supersession, bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.functions.fields import same_error_line
from tracewright.functions.text import instant_us


def latest(df: DataFrame) -> DataFrame:
    """The last stored row of each error id. Combined on the map side, so a hot id moves little."""
    row = F.struct(*[df[c] for c in df.columns])
    return df.groupBy("error_id").agg(F.max_by(row, "seq").alias("row")).select("row.*")


def in_context(df: DataFrame, cwd: str, family: str, now_us: Column, hours: int) -> DataFrame:
    """Rows of a folder and command family deferred within the last hours; unreadable times fall out."""
    at = instant_us(df["deferred_at"])
    return df.where((df["cwd"] == cwd) & (df["command_family"] == family) & (at >= now_us - hours * 3_600_000_000))


def latest_sessions(df: DataFrame) -> DataFrame:
    """cwd, command_family, session_id: the most recent session of each context."""
    when = F.struct(instant_us(df["deferred_at"]).alias("at"), F.col("seq"))
    timed = df.where(instant_us(df["deferred_at"]).isNotNull() & df["session_id"].isNotNull())
    return timed.groupBy("cwd", "command_family").agg(F.max_by("session_id", when).alias("session_id"))


def supersede(df: DataFrame) -> DataFrame:
    """``df`` with the status that results, and the status that ``was``: pending rows of a context's older sessions are superseded.

    Contexts' latest sessions are joined in; no context is gathered in one task.
    """
    newest = latest_sessions(df).withColumnRenamed("session_id", "newest")
    same = df["cwd"].eqNullSafe(newest["cwd"]) & df["command_family"].eqNullSafe(newest["command_family"])
    joined = df.join(newest, same, "left").select(df["*"], "newest")
    old = (F.col("status") == "pending") & F.col("session_id").isNotNull() & (F.col("session_id") != F.col("newest"))
    return joined.withColumn("was", F.col("status")).withColumn("status", F.when(old, "superseded").otherwise(F.col("status"))).drop("newest")


def without_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """The rows whose error id does not begin so; an empty prefix removes nothing."""
    return df.where(~F.col("error_id").startswith(prefix)) if prefix else df


def picked(df: DataFrame, choice: str, order: str = "seq") -> DataFrame:
    """The row that a reader means: the n-th of the listing, else the first whose id begins so."""
    if choice.isdigit() and not df.where(F.col("error_id").startswith(choice)).limit(1).count():
        listed = df.orderBy(order).limit(int(choice)).withColumn("place", F.row_number().over(Window.orderBy(order)))  # as many rows as the number says
        return listed.where(F.col("place") == int(choice)).drop("place")
    return df.where(F.col("error_id").startswith(choice)).orderBy(order).limit(1)


def resolve(entries: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What comes of going through deferred errors by bundle: the errors documented, and the ids that leave the store.

    ``choices``: first_seq of a bundle and choice (``s`` skips, ``q`` quits, anything else documents).
    Bundles come in the order of their first row; after a quit none is documented. All entries leave the
    store in the end, also those skipped.
    """
    quits = choices.where("choice = 'q'").agg(F.min("first_seq")).first()[0]  # one number
    taken = choices.where("choice is null or choice not in ('s', 'q')")
    taken = taken if quits is None else taken.where(F.col("first_seq") < quits)
    documented = entries.join(taken.select(F.col("first_seq").alias("seq")), "seq", "left_semi")
    return documented, entries.select("error_id").distinct()


def older_sessions(df: DataFrame) -> DataFrame:
    """cwd, command_family, sessions, errors: what is still pending from sessions before each context's latest."""
    newest = latest_sessions(df).withColumnRenamed("session_id", "newest")
    same = df["cwd"].eqNullSafe(newest["cwd"]) & df["command_family"].eqNullSafe(newest["command_family"])
    rest = df.join(newest, same).select(df["*"], "newest").where((F.col("status") == "pending") & (F.col("session_id") != F.col("newest")))
    return rest.groupBy("cwd", "command_family").agg(F.countDistinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("errors"))


def elsewhere(df: DataFrame, cwd: str) -> DataFrame:
    """here, there: pending rows of a folder, and of all others."""
    mine = F.col("cwd").eqNullSafe(F.lit(cwd))
    return df.where("status = 'pending'").agg(F.count(F.when(mine, 1)).alias("here"), F.count(F.when(~mine, 1)).alias("there"))


def bundles(df: DataFrame) -> DataFrame:
    """error_code, line, n, first_seq: identical errors, whose order is that of ``first_seq``; rows without a code stay alone."""
    line = same_error_line(df["short_message"])
    alone = F.when(F.coalesce(df["error_code"], F.lit("")) == "", df["seq"])
    grouped = df.groupBy("error_code", F.coalesce(line, F.lit("")).alias("line"), alone.alias("alone")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    return grouped.drop("alone")


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with ``place`` and how many ``more`` the group has."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    firsts = df.withColumn("place", place).where(F.col("place") <= k)
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return firsts.join(sizes.withColumnRenamed(group, "__g"), firsts[group].eqNullSafe(F.col("__g"))).withColumn("more", F.greatest(F.lit(0), F.col("n") - k)).drop("__g", "n")

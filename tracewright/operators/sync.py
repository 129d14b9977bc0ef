"""Reconciling a fix store with what another system has committed, both as tables.

Documents are Markdown; they are the source of truth for what is shared, while what is private stays
local.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.sources.files import from_markdown, to_markdown

_FIX = ["id", "issue", "resolution", "error_excerpt", "tags", "notes", "created_at", "updated_at", "author", "author_email", "is_private"]


def public(fixes: DataFrame, private_ids: DataFrame | None = None) -> DataFrame:
    """The fixes that are neither marked private nor listed (column id)."""
    rows = fixes.where(~F.coalesce("is_private", F.lit(False)))
    return rows if private_ids is None else rows.join(private_ids.select("id"), "id", "left_anti").select(fixes.columns)


def to_push(fixes: DataFrame, committed: DataFrame, private_ids: DataFrame | None = None, everything: bool = False) -> DataFrame:
    """id, markdown of the public fixes whose document is not committed (id, markdown) or reads otherwise."""
    docs = to_markdown(public(fixes, private_ids))
    if everything:
        return docs
    old = committed.select("id", F.col("markdown").alias("__old"))
    return docs.join(old, "id", "left").where(~F.col("markdown").eqNullSafe(F.col("__old"))).select("id", "markdown")


def signed(fixes: DataFrame, name: str | None, email: str | None) -> DataFrame:
    """The fixes with an author filled in where none is named; nothing changes without a name."""
    if not name:
        return fixes
    unsigned = F.coalesce("author", F.lit("")) == ""
    return fixes.withColumns({"author": F.when(unsigned, F.lit(name)).otherwise(F.col("author")), "author_email": F.when(unsigned, F.lit(email)).otherwise(F.col("author_email"))})


def push_message(ids: DataFrame) -> str:
    """The message of a push: the id's start for one fix, else how many. Brings two ids and a count to the driver."""
    n, first = ids.agg(F.count(F.lit(1)), F.min("id")).first()
    return f"Add fix: {first[:8]}" if n == 1 else f"Add/update {n} fixes"


def conflicts(files: DataFrame, local: DataFrame) -> DataFrame:
    """fix_id, conflict_type, known: the fixes of conflicting files (column path); other files are none."""
    fix_id = F.regexp_extract("path", r"^docs/(?:.*/)?([^/]+)\.md$", 1)
    hit = files.select(fix_id.alias("fix_id")).where("fix_id <> ''").distinct()
    have = local.select(F.col("id").alias("fix_id"), F.lit(True).alias("__known")).distinct()
    return hit.join(have, "fix_id", "left").select("fix_id", F.lit("both_modified").alias("conflict_type"), F.coalesce("__known", F.lit(False)).alias("known"))


def rebuilt(local: DataFrame, docs: DataFrame) -> DataFrame:
    """The store after a pull: fixes of documents (id, markdown) in place or added, none deleted; ``is_private`` stays local.

    Documents without an issue or a resolution are passed over.
    """
    parsed = from_markdown(docs).where("issue is not null and resolution is not null").dropDuplicates(["id"])
    flags = local.select("id", F.col("is_private").alias("__p"))
    fresh = parsed.join(flags, "id", "left").withColumn("is_private", F.coalesce("__p", F.lit(False))).select(_FIX)
    return local.join(parsed.select("id"), "id", "left_anti").select(_FIX).unionByName(fresh)


def merged_tags(local: Column, remote: Column) -> Column:
    """The comma-separated tags of both, trimmed, sorted; null if there are none."""
    each = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    return F.nullif(F.array_join(F.array_sort(F.array_union(each(local), each(remote))), ","), F.lit(""))


def merged_notes(local: str, remote: str) -> Column:
    """The notes of both, and the local resolution where it differs; null if there is nothing to say."""
    part = lambda title, c: F.concat(F.lit(f"### {title}:\n"), c)
    mine, theirs = F.col(f"{local}.notes"), F.col(f"{remote}.notes")
    other = ~F.col(f"{local}.resolution").eqNullSafe(F.col(f"{remote}.resolution"))
    notes = F.concat_ws("\n\n", F.when(mine != "", part("Local Notes", mine)), F.when(theirs != "", part("Remote Notes", theirs)), F.when(other, part("Local Resolution (merged)", F.col(f"{local}.resolution"))))
    return F.nullif(notes, F.lit(""))


def resolved(local: DataFrame, remote: DataFrame, choices: DataFrame) -> DataFrame:
    """The fixes that result from choices (id, choice: local, remote or merge) about fixes of both sides.

    Without the side a choice needs there is no row. A merge takes the remote texts, fills what they
    lack, and joins tags and notes.
    """
    l, r = (df.select("id", F.struct(*[c for c in _FIX if c != "id"]).alias(name)) for df, name in ((local, "l"), (remote, "r")))  # noqa: E741
    both = choices.select("id", "choice").join(l, "id", "left").join(r, "id", "left")
    filled = lambda c: F.coalesce(F.nullif(f"r.{c}", F.lit("")), F.nullif(f"l.{c}", F.lit("")))
    merge = {
        "issue": F.col("r.issue"), "resolution": F.col("r.resolution"), "error_excerpt": filled("error_excerpt"), "tags": merged_tags(F.col("l.tags"), F.col("r.tags")), "notes": merged_notes("l", "r"),
        "created_at": F.col("l.created_at"), "updated_at": F.col("r.updated_at"), "author": filled("author"), "author_email": filled("author_email"), "is_private": F.lit(False),
    }
    choice = F.col("choice")
    possible = ((choice == "local") & F.col("l").isNotNull()) | ((choice == "remote") & F.col("r").isNotNull()) | ((choice == "merge") & F.col("l").isNotNull() & F.col("r").isNotNull())
    pick = lambda c: F.when(choice == "local", F.col(f"l.{c}")).when(choice == "remote", F.col(f"r.{c}")).otherwise(merge[c])
    return both.where(possible).select("id", *[pick(c).alias(c) for c in _FIX if c != "id"])


def relation(ahead: Column, behind: Column) -> Column:
    """How two histories stand to each other."""
    return F.when((ahead > 0) & (behind > 0), "diverged").when(ahead > 0, "ahead").when(behind > 0, "behind").otherwise("up_to_date")

"""Fix stores, ticket exports, dependency graphs and Markdown documents as DataFrames, and back.

Unreadable input gives no rows rather than an error, as the stores are written by many hands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.graph import dot_edges
from tracewright.sources.scratch import settle

FIX_SCHEMA = "id string, issue string, resolution string, error_excerpt string, tags string, notes string, created_at string, updated_at string, author string, author_email string, is_private boolean"
#: Delimiters a ticket export may have, and the members that wrap a list of records.
DELIMITERS = ",;\t"
WRAPPERS = ["issues", "records", "results"]
#: What a delimiter is told from.
SNIFFED_CHARS = 2048


def read_fixes(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of fixes with defaults filled in; objects without issue and resolution are left out."""
    rows = spark.read.schema(FIX_SCHEMA + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = rows.where("_corrupt is null and issue is not null and resolution is not null").drop("_corrupt")
    return rows.withColumn("is_private", F.coalesce("is_private", F.lit(False)))


def upsert_fixes(store: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """The store with rows of ``new`` in place of those with the same id; of new rows with one id the last by ``order`` counts (any, without it)."""
    if order is None:
        last = new.dropDuplicates(["id"])
    else:
        last = new.groupBy("id").agg(F.max_by(F.struct(*[c for c in new.columns if c != "id"]), order).alias("r")).select("id", "r.*")
    return store.join(new.select("id"), "id", "left_anti").select(store.columns).unionByName(last.select(store.columns))


def write_store(fixes: DataFrame, path: str) -> None:
    """Replaces the store at ``path`` (Parquet) by these fixes; an empty table purges it."""
    settled = settle(fixes, "store")  # the fixes may come from that very path
    settled.write.mode("overwrite").parquet(path)


def write_markdown(fixes: DataFrame, path: str) -> None:
    """Writes each fix's document as a text file below ``path``, in a folder named after its id."""
    to_markdown(fixes).repartition("id").write.mode("overwrite").partitionBy("id").text(path)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """id, markdown of all documents below ``path``: ``<id>.md``, or what ``write_markdown`` wrote."""
    name = F.col("_metadata.file_path")
    named = F.coalesce(F.nullif(F.regexp_extract(name, r"/id=([^/]+)/[^/]*$", 1), F.lit("")), F.regexp_extract(name, r"/([^/]+)\.md$", 1))
    docs = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    return docs.select(F.url_decode(F.replace(named, F.lit("+"), F.lit("%2B"))).alias("id"), F.col("value").alias("markdown")).where("id <> ''")


PENDING_SCHEMA = "error_id string, error_type string, short_message string, error_excerpt string, tags string, deferred_at string, resource_address string, error_code string, file string, command string, cwd string, session_id string, status string, command_family string, kind string"


def read_pending(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of deferred errors; unreadable files and rows without an id give nothing, a missing status means pending."""
    rows = spark.read.schema(PENDING_SCHEMA + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null and error_id is not null").drop("_corrupt").withColumn("status", F.coalesce("status", F.lit("pending")))


def delete_by_prefix(store: DataFrame, prefix: str, order: str = "id") -> DataFrame:
    """The store without the first row, by ``order``, whose id begins so."""
    first = store.where(F.lower("id").startswith(prefix.lower())).orderBy(order).limit(1).select("id")
    return store.join(first, "id", "left_anti").select(store.columns)


def edited(store: DataFrame, patch: DataFrame, now: str) -> DataFrame:
    """The store with the filled fields of ``patch`` (id and any columns) in place, and ``updated_at`` set where a row was."""
    names = [c for c in patch.columns if c != "id" and c in store.columns]
    p = patch.select("id", *[F.col(c).alias(f"__{c}") for c in names], F.lit(True).alias("__hit"))
    joined = store.join(p, "id", "left")
    new = {c: F.coalesce(F.nullif(F.col(f"__{c}"), F.lit("")), F.col(c)) for c in names}
    new["updated_at"] = F.when(F.col("__hit"), F.lit(now)).otherwise(F.col("updated_at"))
    return joined.withColumns(new).select(store.columns)


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter that occurs most in the first line of an export; a comma if none does."""
    head = spark.read.text(path).select(F.substring("value", 1, SNIFFED_CHARS)).first()
    line = head[0] if head else ""
    best = max(DELIMITERS, key=line.count)
    return best if best in line else ","


def read_ticket_csv(spark: SparkSession, path: str) -> DataFrame:
    """A ticket export with lower-case headers and trimmed cells; quoted cells may span lines."""
    raw = spark.read.option("header", True).option("sep", sniff_delimiter(spark, path)).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    return raw.select(*[F.trim(F.col(f"`{c}`")).alias(c.lstrip("\ufeff").strip().lower()) for c in raw.columns])


def bad_csv_rows(spark: SparkSession, path: str) -> int:
    """How many rows of a ticket export have another number of cells than its header."""
    sep = sniff_delimiter(spark, path)
    options = {"header": True, "sep": sep, "multiLine": True, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    columns = spark.read.options(**options).csv(path).columns
    schema = ", ".join(f"`{c}` string" for c in columns) + ", _corrupt string"
    return spark.read.options(**options).schema(schema).csv(path).where("_corrupt is not null").select(F.count(F.lit(1))).first()[0]


def read_ticket_json(spark: SparkSession, path: str) -> DataFrame:
    """``record`` (variant): the records of an export that is an array, an object with one, or one record."""
    text = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("v")).where("v is not null")
    wrapped = F.coalesce(*[F.try_variant_get("v", f"$.{w}", "array<variant>") for w in WRAPPERS], F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    return text.select(F.explode(wrapped).alias("record"))


def read_dot(spark: SparkSession, path: str) -> DataFrame:
    """The different edges (src, dst) of a dependency graph in DOT."""
    return spark.read.text(path).select(dot_edges(F.col("value")).alias("e")).where("e is not null").select("e.*").distinct()


def to_markdown(fixes: DataFrame) -> DataFrame:
    """id, markdown: a document for each fix; sections of empty fields are left out."""
    line = lambda label, c, mark="": F.when(F.col(c) != "", F.concat(F.lit(f"**{label}:** {mark}"), F.col(c), F.lit(mark)))
    section = lambda title, c: F.when(F.col(c) != "", F.concat(F.lit(f"\n## {title}\n\n"), F.col(c)))
    fenced = F.when(F.col("error_excerpt") != "", F.concat(F.lit("\n## Error Excerpt\n\n```\n"), F.col("error_excerpt"), F.lit("\n```")))
    # The first tag that tells a source and an id.
    sourced = F.coalesce(F.get(F.filter(F.transform(F.split("tags", ","), lambda t: F.trim(t)), lambda t: t.rlike("^source:[^:]*:")), 0), F.lit(""))
    parts = [
        F.concat(F.lit("# Fix: "), F.substring("id", 1, 8), F.lit("\n")),
        line("Created", "created_at"),
        line("Updated", "updated_at"),
        line("Author", "author"),
        line("Author Email", "author_email"),
        line("Tags", "tags", "`"),
        F.when(sourced != "", F.concat(F.lit("**Source:** "), F.regexp_extract(sourced, "^source:([^:]*):(.*)$", 1), F.lit(" / "), F.regexp_extract(sourced, "^source:([^:]*):(.*)$", 2))),
        section("Issue", "issue"),
        section("Resolution", "resolution"),
        fenced,
        section("Notes", "notes"),
    ]
    return fixes.select("id", F.concat(F.concat_ws("\n", *parts), F.lit("\n")).alias("markdown"))


def from_markdown(docs: DataFrame) -> DataFrame:
    """The fixes of documents (id, markdown), as ``to_markdown`` writes them; absent fields are null."""
    m = F.col("markdown")
    got = lambda pattern: F.nullif(F.regexp_extract(m, pattern, 1), F.lit(""))
    field = lambda label: got(rf"(?m)^\*\*{label}:\*\* `?(.*?)`?$")
    section = lambda title: got(rf"(?s)\n## {title}\n\n(.*?)\n(?=\n## (?:Issue|Resolution|Error Excerpt|Notes)\n|\z)")
    return docs.select(
        "id",
        section("Issue").alias("issue"),
        section("Resolution").alias("resolution"),
        got(r"(?s)\n## Error Excerpt\n\n```\n(.*?)\n```\n").alias("error_excerpt"),
        field("Tags").alias("tags"),
        section("Notes").alias("notes"),
        field("Created").alias("created_at"),
        field("Updated").alias("updated_at"),
        field("Author").alias("author"),
        field("Author Email").alias("author_email"),
    )

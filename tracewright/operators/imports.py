"""Ticket exports as fixes: mapping, cleaning, tags, and what becomes of every row.

A source's mapping yields *drafts* (``pos`` that orders them, system, source_id, status, issue,
resolution, error_excerpt, labels, notes; a bad row has no issue or resolution); everything after is the same for
all sources. Values of a row are looked up in a map of its fields, so any export's header will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.fields import keyword_tags, slug, without_markup

#: States in which a ticket is closed, by system.
CLOSED = {"jira": ["done", "closed", "resolved"], "servicenow": ["closed", "resolved", "7", "6"], "notion": ["done", "closed", "resolved", "fixed", "complete", "completed", "solved"]}
#: Types that make a row worth keeping, keywords that do, and lengths kept.
TYPE_TAG = r"^(?:aws_|azurerm_|google_|kubernetes_)\w+$"
KEPT_KEYWORDS = ["kw:terraform", "kw:iam", "kw:rbac", "kw:kubernetes"]
NAMED_TYPES = r"\b((?:aws|azurerm|google|kubernetes)_\w+)\b"
ISSUE, RESOLUTION, EXCERPT = 300, 3000, 2000
#: Names that a page's properties may have, headings of a resolution, and blocks that hold text.
TITLES = ["name", "title", "summary", "incident", "issue", "problem"]
RESOLUTIONS = ["resolution", "fix", "fix / mitigation", "postmortem", "remediation", "outcome", "action taken", "learnings"]
STATUSES = ["status", "state", "ticket status", "progress", "stage"]
SECTIONS = ["fix", "mitigation", "resolution", "fix/mitigation", "root cause", "action taken", "remediation", "workaround", "solution", "steps taken", "corrective action"]
TEXT_BLOCKS = ["paragraph", "heading_1", "heading_2", "heading_3", "bulleted_list_item", "numbered_list_item", "to_do", "quote", "callout"]
_EMPTY = "array<string>"


def field(fields: Column, *names: str) -> Column:
    """The first filled one of several header spellings, blanks or underscores alike; '' if none is."""
    spelled = [s for n in names for s in dict.fromkeys((n, n.replace(" ", "_")))]
    return F.coalesce(*[F.nullif(F.try_element_at(fields, F.lit(n)), F.lit("")) for n in spelled], F.lit(""))


def header_map(df: DataFrame) -> Column:
    """A row of any table as a map of its fields, names in lower case."""
    return F.create_map(*[x for c in df.columns for x in (F.lit(c.strip().lower()), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))])


def last_comment(text: Column) -> Column:
    """The last filled segment of comments parted by lines of hyphens; the whole text if there is one."""
    parts = F.filter(F.transform(F.split(text, r"\n-{5,}\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+\z", "")), lambda s: s != "")
    return F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.regexp_replace(text, r"^\s+|\s+\z", ""))


def first_paragraph(text: Column) -> Column:
    """A text up to its first empty line."""
    return F.substring_index(text, "\n\n", 1)


def _labels(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.replace(text, F.lit(";"), F.lit(",")), ","), lambda t: slug(F.trim(t))), lambda t: t != "")


def jira_rows(fields: Column) -> dict[str, Column]:
    """A draft's columns from a row of a Jira table export."""
    resolution = F.when(field(fields, "resolution") != "", without_markup(field(fields, "resolution"))).otherwise(without_markup(last_comment(field(fields, "comment"))))
    return {
        "source_id": field(fields, "issue key", "key"),
        "status": field(fields, "status", "status category"),
        "issue": without_markup(field(fields, "summary")),
        "resolution": resolution,
        "error_excerpt": without_markup(first_paragraph(field(fields, "description"))),
        "labels": F.concat(_labels(field(fields, "labels")), _labels(field(fields, "components"))),
        "note": F.lit(""),
    }


def jira_records(record: Column) -> dict[str, Column]:
    """A draft's columns from a record (variant) of a Jira backup."""
    at = lambda path, kind="string": F.try_variant_get(record, path, kind)
    text = lambda path: F.regexp_replace(F.coalesce(at(path), F.lit("")), r"^\s+|\s+\z", "")
    comments = F.coalesce(at("$.fields.comment.comments", "array<variant>"), F.array().cast("array<variant>"))
    said = F.when(F.size(comments) > 0, F.coalesce(F.try_variant_get(F.element_at(comments, -1), "$.body", "string"), F.lit(""))).otherwise("")
    parts = F.transform(F.coalesce(at("$.fields.components", "array<variant>"), F.array().cast("array<variant>")), lambda c: F.coalesce(F.try_variant_get(c, "$.name", "string"), F.try_variant_get(c, "$", "string"), F.lit("")))
    labels = F.concat(F.coalesce(at("$.fields.labels", "array<string>"), F.array().cast(_EMPTY)), parts)
    return {
        "source_id": text("$.key"),
        "status": F.coalesce(at("$.fields.status.name"), F.lit("")),
        "issue": without_markup(text("$.fields.summary")),
        "resolution": F.coalesce(F.nullif(text("$.fields.resolution.name"), F.lit("")), without_markup(said)),
        "error_excerpt": without_markup(first_paragraph(text("$.fields.description"))),
        "labels": F.filter(F.transform(labels, lambda t: slug(F.trim(t))), lambda t: t != ""),
        "note": F.lit(""),
    }


def servicenow_rows(fields: Column, use_description: bool = False) -> dict[str, Column]:
    """A draft's columns from a row of a ServiceNow export: close notes before resolution notes before work notes."""
    names = ["close notes", "resolution notes", "work notes", *(["description"] if use_description else [])]
    about = [F.when(field(fields, k) != "", F.concat(F.lit(f"{k}: "), F.trim(field(fields, k)))) for k in ("close code", "assignment group", "category", "subcategory")]
    return {
        "source_id": field(fields, "number"),
        "status": field(fields, "state", "incident state"),
        "issue": without_markup(field(fields, "short description")),
        "resolution": F.coalesce(*[F.nullif(without_markup(field(fields, n)), F.lit("")) for n in names], F.lit("")),
        "error_excerpt": without_markup(field(fields, "description")),
        "labels": F.array().cast(_EMPTY),
        "note": F.concat_ws(" | ", *about),
    }


def property_text(prop: Column) -> Column:
    """The text of a page's property (JSON text) by its type; '' for other types and null."""
    of = lambda path: F.coalesce(F.get_json_object(prop, path), F.lit(""))
    kind = F.get_json_object(prop, "$.type")
    joined = lambda key, part, glue: F.array_join(F.transform(F.from_json(F.get_json_object(prop, f"$.{key}"), f"array<struct<{part}:string>>"), lambda x: F.coalesce(x[part], F.lit(""))), glue)
    case = F.when(kind == "title", joined("title", "plain_text", "")).when(kind == "rich_text", joined("rich_text", "plain_text", ""))
    case = case.when(kind == "select", of("$.select.name")).when(kind == "status", of("$.status.name")).when(kind == "multi_select", joined("multi_select", "name", ", ")).when(kind == "url", of("$.url"))
    return F.coalesce(case, F.lit(""))


def find_property(props: Column, names: list[str]) -> Column:
    """The property whose name is one of ``names`` (the first that is), else whose name holds one; null if none does."""
    entries = F.map_entries(props)
    return F.coalesce(*[_named(entries, n, whole) for whole in (True, False) for n in names])


def _named(entries: Column, name: str, whole: bool) -> Column:
    def fits(e: Column) -> Column:
        key = F.lower(F.trim(e["key"]))
        return key == name if whole else key.contains(name)

    return F.get(F.filter(entries, fits), 0)["value"]


def block_texts(blocks: Column) -> Column:
    """kind, text of the blocks (array of JSON texts) that hold text, in order."""

    def one(b: Column) -> Column:
        kind = F.get_json_object(b, "$.type")
        said = F.coalesce(*[F.when(kind == k, F.array_join(F.transform(F.from_json(F.get_json_object(b, f"$.{k}.rich_text"), "array<struct<plain_text:string>>"), lambda x: F.coalesce(x["plain_text"], F.lit(""))), "")) for k in TEXT_BLOCKS])
        return F.struct(kind.alias("kind"), F.regexp_replace(F.coalesce(said, F.lit("")), r"^\s+|\s+\z", "").alias("text"))

    return F.filter(F.transform(blocks, one), lambda e: e["kind"].isin(TEXT_BLOCKS))


def section_text(texts: Column) -> Column:
    """The lines between the first heading of a resolution and the next heading; '' without such a heading."""
    heading = lambda e: e["kind"].startswith("heading_")
    start = F.array_position(F.transform(texts, lambda e: (heading(e) & F.lower(e["text"]).isin(SECTIONS)).cast("int")), F.lit(1))
    rest = F.when(start > 0, F.slice(texts, start.cast("int") + 1, F.size(texts))).otherwise(F.slice(texts, 1, 0))
    stop = F.array_position(F.transform(rest, lambda e: heading(e).cast("int")), F.lit(1))
    lines = F.when(stop > 0, F.slice(rest, 1, stop.cast("int") - 1)).otherwise(rest)
    return F.array_join(F.filter(F.transform(lines, lambda e: e["text"]), lambda t: t != ""), "\n")


def notion_pages(page: Column, blocks: Column) -> dict[str, Column]:
    """A draft's columns from a page (JSON text) and its blocks (array of JSON texts, may be null)."""
    props = F.from_json(F.get_json_object(page, "$.properties"), "map<string,string>")
    titled = F.get(F.filter(F.map_values(props), lambda p: F.get_json_object(p, "$.type") == "title"), 0)
    title = F.coalesce(F.nullif(without_markup(property_text(find_property(props, TITLES))), F.lit("")), without_markup(property_text(titled)))
    texts = block_texts(F.coalesce(blocks, F.array().cast(_EMPTY)))
    whole = F.array_join(F.filter(F.transform(texts, lambda e: e["text"]), lambda t: t != ""), "\n")
    url = F.coalesce(F.get_json_object(page, "$.url"), F.lit(""))
    return {
        "source_id": F.replace(F.coalesce(F.get_json_object(page, "$.id"), F.lit("")), F.lit("-"), F.lit("")),
        "status": property_text(find_property(props, STATUSES)),
        "issue": title,
        "resolution": F.coalesce(F.nullif(without_markup(property_text(find_property(props, RESOLUTIONS))), F.lit("")), F.nullif(section_text(texts), F.lit("")), whole),
        "error_excerpt": F.left(title, F.lit(120)),
        "labels": F.array().cast(_EMPTY),
        "note": F.when(url != "", F.concat(F.lit("url: "), url)).otherwise(""),
    }


def tag_list(text: Column, source_tag: Column, labels: Column) -> Column:
    """The tags of a draft: named types, keywords, the source, labels; in lower case, each once, the first two sorted."""
    types = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(NAMED_TYPES), F.lit(1))))
    low = F.transform(F.concat(types, F.array_sort(keyword_tags(text)), F.array(source_tag), labels), lambda t: F.lower(F.trim(t)))
    return F.array_distinct(F.filter(low, lambda t: t != ""))


def source_tag(tags: Column) -> Column:
    """The first ``source:`` tag of comma-separated tags; null if there is none."""
    return F.get(F.filter(F.transform(F.split(tags, ","), lambda t: F.trim(t)), lambda t: t.startswith("source:")), 0)


def with_source_tag(tags: Column, tag: Column) -> Column:
    """Comma-separated tags with ``tag`` as the only source, last."""
    others = F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda t: F.trim(t)), lambda t: (t != "") & ~t.startswith("source:"))
    return F.array_join(F.concat(others, F.array(tag)), ",")


def source_id(tags: Column) -> Column:
    """What follows the system in the first source tag; '' without one."""
    return F.coalesce(F.nullif(F.regexp_extract(source_tag(tags), "^source:[^:]*:(.*)$", 1), F.lit("")), F.lit(""))


def drafts(df: DataFrame, pos: Column, system: Column, columns: dict[str, Column], extra_tags: list[str] | None = None) -> DataFrame:
    """pos, system, source_id, status, issue, resolution, error_excerpt, tags, notes and ``bad`` of each row, cut to the lengths kept."""
    rows = df.select(pos.alias("pos"), system.alias("system"), *[c.alias(k) for k, c in columns.items()])
    cut = lambda c, n: F.left(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+\z", ""), F.lit(n))
    named = F.coalesce(F.nullif("source_id", F.lit("")), F.lit("unknown"))
    tag = F.concat(F.lit("source:"), F.col("system"), F.lit(":"), named)
    text = F.concat_ws(" ", "issue", "resolution", "error_excerpt")
    more = F.array(*[F.lit(t.lower()) for t in extra_tags or []]).cast(_EMPTY)
    note = F.concat_ws(" | ", F.concat(F.lit("Source: "), F.col("system"), F.when(F.col("source_id") != "", F.concat(F.lit(" "), F.col("source_id"))).otherwise("")), F.nullif("note", F.lit("")))
    bad = (F.coalesce("issue", F.lit("")) == "") | (F.coalesce("resolution", F.lit("")) == "")
    return rows.select(
        "pos",
        "system",
        "source_id",
        "status",
        cut(F.col("issue"), ISSUE).alias("issue"),
        cut(F.col("resolution"), RESOLUTION).alias("resolution"),
        F.nullif(cut(F.col("error_excerpt"), EXCERPT), F.lit("")).alias("error_excerpt"),
        F.array_join(tag_list(text, tag, F.concat("labels", more)), ",").alias("tags"),
        note.alias("notes"),
        bad.alias("bad"),
    )


def is_closed(system: Column, status: Column) -> Column:
    """Whether a ticket's status means that it is closed, in its system."""
    state = F.lower(F.regexp_replace(F.coalesce(status, F.lit("")), r"^\s+|\s+\z", ""))
    return F.coalesce(*[F.when(system == s, state.isin(names)) for s, names in CLOSED.items()], F.lit(False))


def worth_keeping(tags: Column) -> Column:
    """Whether comma-separated tags name a resource type or one of the keywords that matter."""
    each = F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda t: F.trim(t))
    return F.exists(each, lambda t: t.rlike(TYPE_TAG) | t.isin(KEPT_KEYWORDS))


def disposed(rows: DataFrame, store_tags: DataFrame, closed_only: bool = False, dry_run: bool = False) -> DataFrame:
    """``rows`` (drafts) with ``disposition``: bad, open, duplicate, low_signal or imported.

    ``store_tags``: column tag, the source tags there are already. A row is a duplicate if its source
    tag is there, or (unless it is a dry run) an earlier row with it was imported; rows without a key
    share one tag. The first row of a tag is found by an aggregate, so no tag is gathered in one task.
    """
    marked = rows.withColumn("__tag", source_tag(F.col("tags"))).withColumn("__keep", worth_keeping(F.col("tags")))
    shut = is_closed(F.col("system"), F.col("status")) if closed_only else F.lit(True)
    marked = marked.withColumn("__in", ~F.col("bad") & shut)
    known = store_tags.select(F.col("tag").alias("__tag")).distinct().withColumn("__known", F.lit(True))
    joined = marked.join(known, "__tag", "left").withColumn("__known", F.coalesce("__known", F.lit(False)))
    if dry_run:
        late = F.lit(False)
    else:
        first = marked.where("__in and __keep").groupBy("__tag").agg(F.min("pos").alias("__first"))
        joined = joined.join(first, "__tag", "left")
        late = F.coalesce(F.col("pos") > F.col("__first"), F.lit(False))
    kind = F.when(F.col("bad"), "bad").when(~shut, "open").when(F.col("__known") | late, "duplicate").when(~F.col("__keep"), "low_signal").otherwise("imported")
    return joined.withColumn("disposition", kind).select(*rows.columns, "disposition")


def reviewed(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """``rows`` with a reviewer's decisions (pos, choice: y, s, a, q) in place: what is not skipped and comes before a quit.

    After an ``a`` all further rows are taken unless skipped; after a ``q`` none is.
    """
    both = rows.join(decisions, "pos", "left")
    ends = decisions.agg(F.min(F.when(F.col("choice") == "q", F.col("pos"))).alias("quit"), F.min(F.when(F.col("choice") == "a", F.col("pos"))).alias("every"))
    marks = ends.first()  # one row
    yes = F.col("choice").isin("y", "a")
    yes = yes | ((F.col("pos") >= F.lit(marks["every"])) & (F.coalesce("choice", F.lit("y")) != "s")) if marks["every"] is not None else yes
    yes = yes & (F.col("pos") < F.lit(marks["quit"])) if marks["quit"] is not None else yes
    return both.where(F.coalesce(yes, F.lit(False))).select(rows.columns)


def counters(rows: DataFrame, of: list[str]) -> DataFrame:
    """imported, skipped, duplicates, low_signal, bad_rows of each import."""
    n = lambda d: F.count(F.when(F.col("disposition") == d, 1))
    return rows.groupBy(*of).agg(n("imported").alias("imported"), n("open").alias("skipped"), n("duplicate").alias("duplicates"), n("low_signal").alias("low_signal"), n("bad").alias("bad_rows"))


def top_tags(rows: DataFrame, most: int = 10) -> DataFrame:
    """The most frequent tags of the imported rows: tag, n; ties by the first row."""
    each = rows.where("disposition = 'imported'").select("pos", F.posexplode(F.split("tags", ",")).alias("at", "tag"))
    return each.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pos", "at")).alias("first")).orderBy(F.desc("n"), "first").limit(most).select("tag", "n")

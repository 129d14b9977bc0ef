"""Error rows from the raw output of any tool: routing, one schema for all parsers, and what is made of a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.fields import distinct_ignoring_case, error_id, kind_of
from tracewright.operators.kubernetes import parse_kubernetes, says_helm, says_kubernetes
from tracewright.operators.terraform import parse_terraform, says_terraform

#: Parsers by name, each from (rows, text column) to error rows. A parser that is added here takes part in ``parse_errors``.
PARSERS: dict[str, Callable[[DataFrame, str], DataFrame]] = {"terraform": parse_terraform, "kubernetes": parse_kubernetes}
#: Which parsers a source's texts go to; texts of no known source go to all.
ROUTES = {"terraform": ["terraform"], "kubernetes": ["kubernetes"], "helm": ["kubernetes"]}


def source(text: Column) -> Column:
    """Which tool wrote a text: helm, kubernetes, terraform or unknown (also for null)."""
    known = F.when(says_helm(text), "helm").when(says_kubernetes(text), "kubernetes").when(says_terraform(text), "terraform")
    return F.coalesce(known, F.lit("unknown"))


def parse_errors(df: DataFrame, text: str) -> DataFrame:
    """The error rows of raw outputs: the other columns of ``df``, ``source``, ``error_no`` within text and parser, and the fields of all parsers."""
    routed = df.withColumn("source", source(F.col(text)))
    out = None
    for name, parser in PARSERS.items():
        own = [s for s, names in ROUTES.items() if name in names]
        rows = parser(routed.where(F.col("source").isin(*own) | ~F.col("source").isin(*ROUTES)), text)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.withColumn("error_id", error_id(F.col("resource_address"), F.col("error_code"), F.col("file"), F.col("error_message")))


def first_errors(errors: DataFrame, of: list[str]) -> DataFrame:
    """The first error of each text, told by the columns ``of``; a Terraform row comes before a Kubernetes row."""
    order = F.struct((F.col("error_type") != "terraform").alias("a"), "error_no")
    row = F.struct(*[c for c in errors.columns if c not in of])
    return errors.groupBy(*of).agg(F.min_by(row, order).alias("e")).select(*of, "e.*")


def short_error(code: Column, said: Column, length: int = 100) -> Column:
    """``code: message`` within a length; the code is never cut."""
    left = F.greatest(F.lit(0), F.lit(length - 2) - F.length(code))
    return F.when(code != "", F.concat(code, F.lit(": "), F.left(said, left))).otherwise(F.left(said, F.lit(length)))


def tag_line() -> Column:
    """The comma-separated tags of an error: its own, type, provider, code and kind; of spellings the first stays."""
    more = F.array(F.col("resource_type"), F.when(F.col("cloud_provider") != "unknown", F.col("cloud_provider")), F.col("error_code"), F.col("error_type"))
    return F.array_join(distinct_ignoring_case(F.concat(F.col("tags"), more)), ",")


def issue_line() -> Column:
    """A fix's issue from an error: address, or type and name, then the short error."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    typed = F.coalesce(F.concat(filled("resource_type"), F.lit("/"), filled("resource_name")), filled("resource_type"))
    return F.concat_ws(": ", F.coalesce(filled("resource_address"), typed), short_error(F.col("error_code"), F.col("error_message")))


def to_pending(errors: DataFrame, keep: list[str]) -> DataFrame:
    """The rows of deferred errors made of parsed ones; ``keep``: columns such as command, cwd, session_id that go along."""
    return errors.select(
        *keep,
        "error_id",
        "error_type",
        short_error(F.col("error_code"), F.col("error_message"), 120).alias("short_message"),
        F.left(F.col("raw_output"), F.lit(2000)).alias("error_excerpt"),
        tag_line().alias("tags"),
        "resource_address",
        "error_code",
        F.concat_ws(":", F.col("file"), F.when(F.col("file").isNotNull(), F.col("line").cast("string"))).alias("file"),
        kind_of(F.col("resource_address")).alias("kind"),
    ).withColumn("file", F.nullif("file", F.lit("")))


def to_fixes(errors: DataFrame, keep: list[str], resolution: Column, user_tags: Column, excerpt: int = 2000) -> DataFrame:
    """Fix rows made of parsed errors: issue, resolution, excerpt and tags, the user's tags merged in."""
    split = F.transform(F.split(F.coalesce(user_tags, F.lit("")), ","), lambda t: F.trim(t))
    tags = F.array_join(distinct_ignoring_case(F.concat(F.split(tag_line(), ","), split)), ",")
    return errors.select(*keep, issue_line().alias("issue"), resolution.alias("resolution"), F.left(F.col("raw_output"), F.lit(excerpt)).alias("error_excerpt"), tags.alias("tags"))


def quick_capture(text: Column) -> Column:
    """issue and resolution of ``issue | resolution``, cut at the first bar; the resolution is null without one."""
    halves = F.split(text, r"\|", 2)
    return F.struct(F.trim(halves[0]).alias("issue"), F.nullif(F.trim(F.get(halves, F.lit(1))), F.lit("")).alias("resolution"))


def summary(errors: DataFrame, of: list[str]) -> DataFrame:
    """One line for the errors of each text: its short error if there is one, else how many of each kind."""
    line = short_error(F.col("error_code"), F.col("error_message"))
    kinds = errors.withColumn("__line", line).groupBy(*of, "error_type").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("error_no", "__line")).alias("first"))
    both = kinds.groupBy(*of).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct((F.col("error_type") != "terraform").alias("o"), "error_type", "n", "first"))).alias("kinds"))
    one = F.concat(F.lit("1 "), F.col("kinds")[0]["error_type"], F.lit(" error: "), F.col("kinds")[0]["first"]["__line"])
    many = F.concat(F.col("n").cast("string"), F.lit(" errors found: "), F.array_join(F.transform("kinds", lambda k: F.concat(k["n"].cast("string"), F.lit(" "), k["error_type"], F.lit(" error(s)"))), ", "))
    return both.select(*of, F.col("n").cast("long").alias("n"), F.when(F.col("n") == 1, one).otherwise(many).alias("summary"))

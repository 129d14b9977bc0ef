"""Keyword, tag and type search over fixes, and rankings of what is found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.functions.fields import comma_tags, searchable

#: Fixed value: words too common to tell texts apart.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might must shall "
    "can need dare ought used to of in for on with at by from as into through during before after above below between "
    "under again further then once here there when where why how all each few more most other some such no nor not only "
    "own same so than too very just and but if or because until while this that these those it its error failed failure"
).split()


def text_of(df: DataFrame) -> Column:
    """What a keyword search looks at."""
    return searchable(*[df[c] for c in ("issue", "resolution", "error_excerpt", "tags", "notes")])


def by_words(df: DataFrame, query: str, any_word: bool = False) -> DataFrame:
    """Rows whose text contains all (or any) of the query's words, as substrings. An empty query finds nothing."""
    words = query.lower().split()
    if not words:
        return df.where(F.lit(False))
    text = text_of(df)
    return df.where(reduce((lambda a, b: a | b) if any_word else (lambda a, b: a & b), [text.contains(w) for w in words]))


def by_tags(df: DataFrame, tags: list[str], any_tag: bool = False) -> DataFrame:
    """Rows that have all (or any) of the tags, ignoring case. No tags wanted: every row."""
    if not tags:
        return df
    wanted = F.array(*[F.lit(t.strip().lower()) for t in tags])
    have = comma_tags(df["tags"])
    return df.where(F.arrays_overlap(have, wanted) if any_tag else F.size(F.array_except(wanted, have)) == 0)


def by_type(df: DataFrame, resource_type: str) -> DataFrame:
    """Rows whose raw tags contain the type as a substring."""
    return df.where(F.lower("tags").contains(resource_type.lower()))


def by_whole_type(df: DataFrame, resource_type: str) -> DataFrame:
    """Rows that have the type as a tag, or as a whole word of their text."""
    word = r"(?i)\b\Q" + resource_type + r"\E\b"
    return df.where(F.array_contains(comma_tags(df["tags"]), resource_type.lower()) | text_of(df).rlike(word))


def by_id_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """The first row in storage order whose id begins so, ignoring case."""
    return df.where(F.lower("id").startswith(prefix.lower())).orderBy("seq").limit(1)


def keywords(c: Column) -> Column:
    """The different words of three letters or more letters of any script, without stop words."""
    words = F.split(F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}_\s]", ""), r"(?U)\s+")
    return F.array_except(F.filter(F.array_distinct(words), lambda w: F.length(w) > 2), F.array(*[F.lit(w) for w in STOP_WORDS]))


def cluster_key(issue: Column) -> Column:
    """The first CamelCase token of an issue, else its first four words in lower case without punctuation; '' for null."""
    words = F.filter(F.split(F.lower(F.regexp_replace(issue, r"(?U)[^\w\s]", "")), r"(?U)\s+"), lambda w: w != "")
    camel = F.nullif(F.regexp_extract(issue, "[A-Z][a-z]+(?:[A-Z][a-z]+)+", 0), F.lit(""))
    return F.coalesce(camel, F.array_join(F.slice(words, 1, 4), " "), F.lit(""))


def most_alike(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """query, item, shared, score: the ``k`` items that share most with each query, by Jaccard similarity of words.

    Both have id and words (array). They meet through an inverted index on words; counts of shared
    words are added up on the map side. Words that lie in more than half of the items tell nothing
    apart but still count.
    """
    q = queries.select(F.col("id").alias("query"), F.size("words").alias("qn"), F.explode("words").alias("w"))
    i = items.select(F.col("id").alias("item"), F.size("words").alias("n"), F.explode("words").alias("w"))
    met = q.join(i, "w").where(F.col("query") != F.col("item")).groupBy("query", "item").agg(F.count(F.lit(1)).alias("shared"), F.any_value("qn").alias("qn"), F.any_value("n").alias("n"))
    score = F.round(F.col("shared") / (F.col("qn") + F.col("n") - F.col("shared")), 6)
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item"))
    return met.withColumn("score", score).withColumn("place", best).where(F.col("place") <= k).select("query", "item", "shared", "score", "place")


def anchor(needle: Column) -> Column:
    """The characters about a needle's last dot, which a text that holds it has too; null without a dot between others."""
    long, short = F.regexp_extract(needle, r"(.{3}\..)[^.]*$", 1), F.regexp_extract(needle, r"(.\..)[^.]*$", 1)
    return F.when(long != "", F.concat(F.lit("3"), long)).when(short != "", F.concat(F.lit("1"), short))


def anchors(text: Column) -> Column:
    """The characters about all dots of a text, as ``anchor`` gives them."""
    three = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)(?=(.{3}\..))"), F.lit(1)), lambda a: F.concat(F.lit("3"), a))
    one = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)(?=(.\..))"), F.lit(1)), lambda a: F.concat(F.lit("1"), a))
    return F.array_union(three, one)


#: Fixed value: characters of a needle by which it is looked up, at most.
START = 8


def starts_in(needles: DataFrame, words: DataFrame) -> DataFrame:
    """needle, word: which needles (column needle) lie within which different words (column word), as substrings.

    Words are cut into pieces as long as the needles' first characters (START at most), meet those as equals, and
    are then looked through. The lengths come to the driver: START numbers at most.
    """
    opened = needles.select("needle", F.left("needle", F.lit(START)).alias("start"))
    lengths = sorted(r[0] for r in opened.select(F.length("start")).distinct().collect())

    def cut(n: int) -> Column:
        at = F.when(F.length("word") >= n, F.sequence(F.lit(1), F.length("word") - F.lit(n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.substring(F.col("word"), i, F.lit(n)))

    pieces = words.select("word", F.explode(F.array_distinct(F.concat(*map(cut, lengths)) if lengths else F.array().cast("array<string>"))).alias("start"))
    return pieces.join(opened, "start").where(F.col("word").contains(F.col("needle"))).select("needle", "word")


def needles_in(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """needle, seq: which different needles (column needle) lie within which texts (seq, t), as substrings.

    A needle of word characters lies within a word and is looked for in the corpus's different words
    (``starts_in``). One with a dot meets texts by the characters about it and is then looked for. Needles of other
    forms are not supported and meet nothing.
    """
    needles = needles.where(F.length("needle") > 0).distinct()
    dotted = needles.where(~F.col("needle").rlike(r"^\w+$")).select("needle", anchor(F.col("needle")).alias("anchor"))
    spots = texts.select("seq", "t", F.explode(anchors(F.col("t"))).alias("anchor"))
    by_dot = dotted.join(spots, "anchor").where(F.col("t").contains(F.col("needle"))).select("needle", "seq")
    plain = needles.where(F.col("needle").rlike(r"^\w+$"))
    if plain.isEmpty():
        return by_dot
    words = texts.select("seq", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(r"\w+"), F.lit(0)))).alias("word"))
    by_word = starts_in(plain, words.select("word").distinct()).join(words, "word").select("needle", "seq").distinct()
    return by_word.unionByName(by_dot)

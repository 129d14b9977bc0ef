"""Queries of search, listing and statistics over fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.fields import comma_tags, filled, searchable
from tracewright.functions.text import instant_us
from tracewright.operators import search as S
from tracewright.operators.pending import top_per_group
from tracewright.operators.similar import similar_fixes
from tracewright.sources.tables import load

_TEXT = "lower(concat_ws(' ', nullif(issue,''), nullif(resolution,''), nullif(error_excerpt,''), nullif(tags,''), nullif(notes,'')))"
_TAGS = "list_distinct(list_filter(list_transform(string_split(coalesce(tags,''),','), lambda t: lower(trim(t))), lambda t: t<>''))"
_WORDS = "list_distinct(list_filter(string_split_regex(regexp_replace(lower(issue), '[^a-z0-9_\\s]', '', 'g'), '\\s+'), lambda w: length(w)>2 and not list_contains([%s], w)))" % ", ".join(f"'{w}'" for w in S.STOP_WORDS)


def _fixes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "fixes")


def search_all_words(spark: SparkSession, d: str) -> DataFrame:
    """Fixes whose text has both words."""
    return S.by_words(_fixes(spark, d), "bucket Role").select("seq", "id")


def search_any_word(spark: SparkSession, d: str) -> DataFrame:
    """Fixes whose text has either word."""
    return S.by_words(_fixes(spark, d), "throttles quota", any_word=True).select("seq", "id")


def search_words_and_tags(spark: SparkSession, d: str) -> DataFrame:
    """Keyword search, then tags, then the first ten in storage order."""
    found = S.by_tags(S.by_words(_fixes(spark, d), "the"), ["aws"])
    return found.orderBy("seq").limit(10).select("seq", "id")


def tags_all(spark: SparkSession, d: str) -> DataFrame:
    """Fixes with both tags."""
    return S.by_tags(_fixes(spark, d), ["AWS", "kw:s3"]).select("seq")


def tags_any(spark: SparkSession, d: str) -> DataFrame:
    """Fixes with either tag."""
    return S.by_tags(_fixes(spark, d), ["drift", "kw:rbac"], any_tag=True).select("seq")


def type_in_tags(spark: SparkSession, d: str) -> DataFrame:
    """Fixes whose tags contain a resource type as a substring."""
    return S.by_type(_fixes(spark, d), "aws_iam_role").select("seq")


def type_whole_word(spark: SparkSession, d: str) -> DataFrame:
    """Fixes with a resource type as a tag or whole word."""
    return S.by_whole_type(_fixes(spark, d), "aws_iam_role").select("seq")


def get_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The first fix whose id begins with a prefix."""
    return S.by_id_prefix(_fixes(spark, d), "5B").select("seq", "id")


def get_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Fixes of an exact id: the filter reaches the scan."""
    return _fixes(spark, d).where(F.col("id") == "5b0136fa-c1ee-4db4-af03-0005deece66d").select("seq", "issue")


def fix_ids(spark: SparkSession, d: str) -> DataFrame:
    """The different ids."""
    return _fixes(spark, d).select("id").distinct()


def list_recent(spark: SparkSession, d: str) -> DataFrame:
    """The twenty newest fixes by their creation time as written."""
    return _fixes(spark, d).orderBy(F.desc_nulls_last("created_at"), "seq").limit(20).select("seq", "id", "created_at")


def stats_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many fixes there are, and how many have tags, excerpts, or are private."""
    have = lambda c: F.count(F.when(F.col(c) != "", 1))
    return _fixes(spark, d).agg(F.count(F.lit(1)).alias("total"), have("tags").alias("with_tags"), have("error_excerpt").alias("with_excerpt"), F.count(F.when(F.col("is_private"), 1)).alias("private"))


def top_tags(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent comma tags, case kept; ties by first appearance."""
    parts = _fixes(spark, d).where(F.col("tags") != "").select("seq", F.posexplode(F.split("tags", ",")).alias("at", "tag"))
    counted = parts.groupBy(F.trim("tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "at")).alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(10).select("tag", "n")


def summary_line(spark: SparkSession, d: str) -> DataFrame:
    """One line for each fix."""
    issue = F.when(F.length("issue") > 40, F.concat(F.substring("issue", 1, 40), F.lit("..."))).otherwise(F.col("issue"))
    return _fixes(spark, d).select("seq", F.concat(F.substring("id", 1, 8), F.lit(" | "), F.coalesce(F.nullif("tags", F.lit("")), F.lit("-")), F.lit(" | "), issue).alias("line"))


def history_best(spark: SparkSession, d: str) -> DataFrame:
    """Of the fixes with the same first CamelCase token (else first four words), the one with an excerpt, then the newest, then the first."""
    fixes = _fixes(spark, d)
    order = F.struct(filled(F.col("error_excerpt")).cast("int").alias("a"), F.coalesce(instant_us(fixes["created_at"]), F.lit(0)).alias("b"), (-F.col("seq")).alias("c"))
    return fixes.groupBy(S.cluster_key(F.col("issue")).alias("cluster")).agg(F.max_by("seq", order).alias("seq"), F.count(F.lit(1)).alias("n"))


def similar_topk(spark: SparkSession, d: str) -> DataFrame:
    """For every hundredth fix the five whose issues share most words with its own."""
    words = _fixes(spark, d).select(F.col("seq").alias("id"), S.keywords(F.col("issue")).alias("words"))
    return S.most_alike(words.where("id % 100 = 0"), words, 5)


def similar_errors(spark: SparkSession, d: str) -> DataFrame:
    """For every hundredth deferred error the five fixes most like it, by all signals."""
    errors = load(spark, d, "pending_errors").where("seq % 100 = 0").select(F.col("seq").alias("query"), F.col("error_excerpt").alias("text"), "tags", F.col("resource_address").alias("address"))
    return similar_fixes(errors, _fixes(spark, d))


def top_fixes_per_author(spark: SparkSession, d: str) -> DataFrame:
    """The two first fixes of each author, and how many more there are."""
    return top_per_group(_fixes(spark, d).select("author", "seq"), "author", [F.col("seq")], 2)


def tag_pairs(spark: SparkSession, d: str) -> DataFrame:
    """How often two tags occur together in a fix."""
    tags = _fixes(spark, d).select(F.array_sort(comma_tags(F.col("tags"))).alias("t"))
    pairs = tags.select(F.explode("t").alias("a"), "t").select("a", F.explode("t").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def searchable_length(spark: SparkSession, d: str) -> DataFrame:
    """The length of each fix's search text."""
    return _fixes(spark, d).select("seq", F.length(searchable(*[F.col(c) for c in ("issue", "resolution", "error_excerpt", "tags", "notes")])).alias("n"))


_STOPS = ", ".join(f"'{w}'" for w in S.STOP_WORDS)
_KW = "list_distinct(list_filter(string_split_regex(regexp_replace(lower(coalesce({t},'')), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+'), lambda w: length(w)>2 and not list_contains([" + _STOPS.replace("{", "").replace("}", "") + "], w)))"
_CODES = "list_distinct(list_concat(regexp_extract_all({t}, 'code[:\\s]*[\"'']?(\\w+)[\"'']?', 1), regexp_extract_all({t}, '\\b(4[0-9][0-9]|5[0-9][0-9])\\b', 1), regexp_extract_all({t}, 'error:\\s+(\\w+(?:\\.\\w+)*)', 1), regexp_extract_all({t}, '<code>(\\w+)</code>', 1), regexp_extract_all({t}, 'statuscode[=:]?\\s*(\\d+)', 1), regexp_extract_all({t}, 'api error (\\w+(?:\\.\\w+)*)', 1), list_filter(['accessdenied','authorizationfailed','forbidden','unauthorized','notfound','timeout','connectionrefused','permissiondenied','invalidrequest','quotaexceeded','throttled','conflict'], lambda n: contains({t}, n))))"
_NTYPES = "list_distinct(regexp_extract_all(lower({t}), '((?:aws|azurerm|google)_\\w+)', 1))"
QUERIES = {
    f.__name__: f
    for f in (search_all_words, search_any_word, search_words_and_tags, tags_all, tags_any, type_in_tags, type_whole_word, get_by_prefix, get_by_id, fix_ids, list_recent, stats_counts, top_tags, summary_line, history_best, similar_topk, similar_errors, top_fixes_per_author, tag_pairs, searchable_length)
}
SQL = {
    "search_all_words": f"SELECT seq, id FROM fixes WHERE contains({_TEXT},'bucket') AND contains({_TEXT},'role')",
    "search_any_word": f"SELECT seq, id FROM fixes WHERE contains({_TEXT},'throttles') OR contains({_TEXT},'quota')",
    "search_words_and_tags": f"SELECT seq, id FROM fixes WHERE contains({_TEXT},'the') AND list_contains({_TAGS},'aws') ORDER BY seq LIMIT 10",
    "tags_all": f"SELECT seq FROM fixes WHERE list_has_all({_TAGS}, ['aws','kw:s3'])",
    "tags_any": f"SELECT seq FROM fixes WHERE list_has_any({_TAGS}, ['drift','kw:rbac'])",
    "type_in_tags": "SELECT seq FROM fixes WHERE contains(lower(tags),'aws_iam_role')",
    "type_whole_word": f"SELECT seq FROM fixes WHERE list_contains({_TAGS},'aws_iam_role') OR regexp_matches({_TEXT}, '(?i)\\baws_iam_role\\b')",
    "get_by_prefix": "SELECT seq, id FROM fixes WHERE starts_with(lower(id),'5b') ORDER BY seq LIMIT 1",
    "get_by_id": "SELECT seq, issue FROM fixes WHERE id = '5b0136fa-c1ee-4db4-af03-0005deece66d'",
    "fix_ids": "SELECT DISTINCT id FROM fixes",
    "list_recent": "SELECT seq, id, created_at FROM fixes ORDER BY created_at DESC NULLS LAST, seq LIMIT 20",
    "stats_counts": "SELECT count(*) AS total, count(*) FILTER (tags<>'') AS with_tags, count(*) FILTER (error_excerpt<>'') AS with_excerpt, count(*) FILTER (is_private) AS private FROM fixes",
    "top_tags": "SELECT tag, n FROM (SELECT trim(t) AS tag, count(*) AS n, min(seq*100000+i) AS f FROM (SELECT seq, unnest(string_split(tags,',')) AS t, generate_subscripts(string_split(tags,','),1) AS i FROM fixes WHERE tags<>'') GROUP BY 1) ORDER BY n DESC, f LIMIT 10",
    "summary_line": "SELECT seq, substr(id,1,8) || ' | ' || coalesce(nullif(tags,''),'-') || ' | ' || CASE WHEN length(issue)>40 THEN substr(issue,1,40)||'...' ELSE issue END AS line FROM fixes",
    "history_best": "SELECT coalesce(nullif(regexp_extract(issue,'[A-Z][a-z]+(?:[A-Z][a-z]+)+',0),''), array_to_string(list_slice(list_filter(string_split_regex(lower(regexp_replace(issue,'[^\\w\\s]','','g')),'\\s+'), lambda x: x<>''),1,4),' ')) AS cluster, arg_max(seq, row(CASE WHEN regexp_matches(coalesce(error_excerpt,''),'\\S') THEN 1 ELSE 0 END, coalesce(epoch_us(CAST(CASE WHEN regexp_matches(created_at,'(Z|[+-][0-9]{2}:[0-9]{2})$') THEN created_at ELSE created_at||'Z' END AS TIMESTAMPTZ)),0), -seq)) AS seq, count(*) AS n FROM fixes GROUP BY 1",
    "similar_topk": f"WITH w AS (SELECT seq AS id, {_WORDS} AS words FROM fixes), e AS (SELECT id, len(words) AS n, unnest(words) AS w FROM w), m AS (SELECT q.id AS query, i.id AS item, count(*) AS shared, any_value(q.n) AS qn, any_value(i.n) AS n FROM e q JOIN e i USING (w) WHERE q.id%100=0 AND q.id<>i.id GROUP BY 1,2), s AS (SELECT *, round(shared/(qn+n-shared),6) AS score FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS place FROM s) SELECT query, item, shared, score, place FROM r WHERE place<=5",
    "top_fixes_per_author": "WITH r AS (SELECT author, seq, row_number() OVER (PARTITION BY author ORDER BY seq) AS place, count(*) OVER (PARTITION BY author) AS n FROM fixes) SELECT author, seq, place, greatest(0,n-2) AS more FROM r WHERE place<=2",
    "tag_pairs": f"WITH t AS (SELECT seq, unnest({_TAGS}) AS t FROM fixes) SELECT a.t AS a, b.t AS b, count(*) AS n FROM t a JOIN t b ON a.seq=b.seq AND a.t<b.t GROUP BY 1,2",
    "searchable_length": f"SELECT seq, length({_TEXT}) AS n FROM fixes",
}
SQL["similar_errors"] = f"""
WITH q AS (SELECT seq AS query, {_KW.format(t="error_excerpt")} AS words, lower(coalesce(error_excerpt,'')) AS low, {_TAGS} AS tags, list_distinct(list_filter(list_concat([lower(nullif(resource_address,''))], regexp_extract_all(lower(coalesce(error_excerpt,'')), '((?:aws|azurerm|google)_\\w+\\.\\w+)', 1)), lambda x: x IS NOT NULL)) AS addresses FROM pending_errors WHERE seq % 100 = 0),
q2 AS (SELECT *, {_CODES.format(t="low")} AS codes, {_NTYPES.format(t="low")} AS types, list_filter(tags, lambda t: NOT regexp_full_match(t, '(?:aws|azurerm|google)_\\w+')) AS plain FROM q),
f AS (SELECT seq, {_KW.format(t="concat_ws(' ', nullif(error_excerpt,''), nullif(issue,''))")} AS w, {_KW.format(t="issue")} AS wi, {_KW.format(t="resolution")} AS wr, list_filter({_TAGS}, lambda t: NOT regexp_full_match(t, '(?:aws|azurerm|google)_\\w+')) AS plain, lower(concat_ws(' ', nullif(issue,''), nullif(error_excerpt,''), nullif(tags,''))) AS every, lower(coalesce(error_excerpt,'')) AS ex, lower(coalesce(issue,'')) AS iss, lower(coalesce(tags,'')) AS tg,
  array_to_string(list_sort({_NTYPES.format(t="concat_ws(' ', nullif(tags,''), nullif(error_excerpt,''))")}),'|') || '||' || array_to_string(list_sort({_CODES.format(t="lower(coalesce(error_excerpt,''))")}),'|') || '||' || array_to_string(list_sort({_KW.format(t="issue")})[1:3],'|') AS kind FROM fixes),
s AS (SELECT query, seq, kind, 25*len(list_filter(addresses, lambda a: contains(every,a))) + 20*len(list_filter(codes, lambda c: contains(ex,c))) + 20*len(list_filter(codes, lambda c: contains(iss,c))) + CAST(floor(15*len(list_intersect(words,w))/greatest(1,len(list_distinct(list_concat(words,w))))) AS INT) + 8*len(list_filter(types, lambda t: contains(tg,t))) + 5*len(list_intersect(q2.plain,f.plain)) + 2*len(list_intersect(words,wi)) + len(list_intersect(words,wr)) AS score FROM q2 CROSS JOIN f),
b AS (SELECT query, kind, max(score) AS score, arg_max(seq, row(score,-seq)) AS seq FROM s WHERE score>=15 GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, seq) AS place FROM b) SELECT query, place, seq, score FROM r WHERE place<=5"""

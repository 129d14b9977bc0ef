"""Finding and replacing personal data by weak supervision.

Labelers vote on candidate spans (``pii_spans``). For each type, expectation-maximisation over the
counts of all vote patterns estimates how reliable each labeler is, and from that how probably a
candidate with a given pattern is personal. A classifier with the votes, the words around the
candidate and its shape as features is then trained on these probabilities, and decides.

All texts are read for the lists of names and towns, the pattern counts and the decisions. The lists
hold every word met, however rare, as written tables; what is known of a text's words is joined to it,
and how often a word was counted is a feature. Only the classifier is fitted on a sample: at most TRAINED candidates of each type, taken by least hash of their place (row and start).

Cases with a defined result: null and empty texts have no spans and stay as they are; texts of any
length are read whole; where accepted spans overlap, the more probable one counts (then the longer);
a piece that stands twice in a field is found once but replaced everywhere it was accepted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.pii_spans import LABELERS, LISTABLE, TYPES, Gazetteer, Span, candidates, fold, lookups, names_in_emails, towns_of
from tracewright.sources.scratch import settle, spread

#: Candidates of a type that its classifier is fitted on, at most.
TRAINED = 20_000
#: Slots of the hashed features.
SLOTS = 1 << 12


@F.pandas_udf(T.StringType())
def _folded(words: pd.Series) -> pd.Series:
    return words.map(fold, na_action="ignore")


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text), 256))


@dataclass(frozen=True)
class Lists:
    """Written tables of all names and towns ever met: ``words`` (list, word, n) and the parts that names share.

    Nothing is left out for being rare, and the tables stay distributed: each text is told, by joins,
    what is known of its own words.
    """

    words: DataFrame
    heads: DataFrame
    tails: DataFrame

    @staticmethod
    def learn(texts: DataFrame, roster: DataFrame, authors: DataFrame) -> Lists:
        """Names from the staff list, from authors and from addresses that spell a name; towns that stand beside post codes."""

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for t in batch["text"]:
                    if "@" in t:
                        for g, f in names_in_emails(t):
                            rows += [("given", fold(g)), ("family", fold(f))]
                    rows += [("town", w) for w in towns_of(t)]
                yield pd.DataFrame(rows, columns=["list", "word"])

        def named(people: DataFrame, given: Column, family: Column) -> DataFrame:
            both = F.array(F.struct(F.lit("given").alias("list"), given.alias("word")), F.struct(F.lit("family").alias("list"), family.alias("word")))
            return people.select(F.explode(both).alias("e")).select("e.list", _folded("e.word").alias("word"))

        name = F.split(F.trim("author"), r"\s+")
        signed = named(authors.where(F.size(name) == 2), name[0], name[1])
        staff = named(roster, F.col("given_name"), F.col("family_name"))
        all_words = texts.select("text").mapInPandas(find, "list string, word string").unionByName(signed).unionByName(staff)
        words = all_words.where((F.col("list") == "town") | F.col("word").rlike(f"^{LISTABLE.pattern}$"))
        words = settle(words.groupBy("list", "word").agg(F.count(F.lit(1)).alias("n")), "lists")
        parts = _split(words.where("list <> 'town' and length(word) >= 4"))
        shared = lambda part: parts.groupBy("list", part).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        return Lists(words, settle(shared("head"), "name-heads"), settle(shared("tail"), "name-tails"))

    def tell(self, texts: DataFrame) -> DataFrame:
        """digest, known: for each different text (column ``text``) what the lists say of its words, as ``Gazetteer.told`` reads it."""

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(d, kind, w) for d, t in zip(batch["digest"], batch["text"], strict=True) for kind, w in sorted(lookups(t))]
                yield pd.DataFrame(rows, columns=["digest", "asked", "word"])

        different = texts.where(F.length("text") > 0).select(_digest("text").alias("digest"), "text").dropDuplicates(["digest"])
        asked = settle(different.mapInPandas(look, "digest binary, asked string, word string"), "looked-up")
        vocabulary = asked.select("asked", "word").distinct()
        kind = F.when(F.col("list") == "town", "town").otherwise("name").alias("asked")
        listed = self.words.select("list", "word", "n", kind).join(vocabulary, ["asked", "word"])
        # A word longer than two shared parts cannot be made of them.
        longest = self.words.where("list <> 'town'").agg((2 * F.max(F.length("word"))).alias("longest"))
        names = vocabulary.where("asked = 'name' and length(word) >= 5").crossJoin(F.broadcast(longest)).where("length(word) <= longest")
        made = _split(names.drop("longest")).join(self.heads, "head").join(self.tails, ["list", "tail"]).select("list", "word", F.lit(0).cast("long").alias("n"), "asked")
        known = listed.select("list", "word", "n", "asked").unionByName(made).groupBy("asked", "list", "word").agg(F.max("n").alias("n"))
        told = F.concat(F.substring("list", 1, 1), F.least("n", F.lit(2)).cast("string"), F.col("word"))
        return asked.join(known, ["asked", "word"]).groupBy("digest").agg(F.collect_list(told).alias("known"))


def _split(words: DataFrame) -> DataFrame:
    """``words`` with head and tail: each way to cut a word in two of at least two letters."""
    cuts = words.withColumn("cut", F.explode(F.sequence(F.lit(2), F.length("word") - 2)))
    return cuts.withColumn("head", F.expr("substring(word, 1, cut)")).withColumn("tail", F.expr("substring(word, cut + 1)")).drop("cut")


def _with_known(df: DataFrame, text: str, told: DataFrame, name: str) -> DataFrame:
    """``df`` with what is known of the words of column ``text`` as column ``name``."""
    return df.withColumn("__digest", _digest(text)).join(told.select(F.col("digest").alias("__digest"), F.col("known").alias(name)), "__digest", "left").drop("__digest")


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """For each vote pattern (rows of -1, 0, 1) the probability of being personal.

    Labelers vote independently given the truth; each has its own chances of -1, 0 and 1 for either
    truth. Starts from the majority of votes. The chances are smoothed, so no vote is ever proof.
    """
    p = 1 / (1 + np.exp(-patterns.sum(axis=1).astype(float)))
    weight = counts.astype(float)
    for _ in range(rounds):
        log_odds = np.log((weight @ p + 1) / (weight @ (1 - p) + 1)) * np.ones(len(p))
        for k in range(patterns.shape[1]):
            for v in (-1, 0, 1):
                at = patterns[:, k] == v
                yes, no = (weight * p)[at].sum() + 1, (weight * (1 - p))[at].sum() + 1
                log_odds[at] += np.log(yes / ((weight @ p) + 3)) - np.log(no / ((weight @ (1 - p)) + 3))
        new = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p


def _vector(votes: np.ndarray, features: list[str]) -> np.ndarray:
    """Indices of the features that are on: one per vote value, and hashed ones."""
    import xxhash

    fixed = [3 * k + int(v) + 1 for k, v in enumerate(votes)]
    return np.array(fixed + [3 * LABELERS + xxhash.xxh32_intdigest(f) % SLOTS for f in features], np.int64)


class Classifier:
    """Logistic regression per type over sparse features, fitted to probabilities."""

    def __init__(self) -> None:
        self.weights: dict[str, np.ndarray] = {}

    def fit(self, kind: str, rows: list[np.ndarray], target: np.ndarray, rounds: int = 60, penalty: float = 1e-3) -> None:
        """Full-batch gradient steps with per-weight step sizes; the same result for the same rows."""
        size = 3 * LABELERS + SLOTS + 1
        w, scale = np.zeros(size), np.full(size, 1e-8)
        at = np.concatenate(rows)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        for _ in range(rounds):
            z = np.bincount(row, w[at], len(rows)) + w[-1]
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
            grad = np.bincount(at, error[row], size) / len(rows) + penalty * w
            grad[-1] = error.mean()
            scale += grad**2
            w -= 0.5 * grad / np.sqrt(scale)
        self.weights[kind] = w

    def probability(self, kind: str, votes: np.ndarray, features: list[str]) -> float:
        """How probably a candidate is personal; 0 for types without any candidate to learn from."""
        w = self.weights.get(kind)
        if w is None:
            return 0.0
        z = w[_vector(votes, features)].sum() + w[-1]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class Finder:
    """What a run has learned: the lists and the classifier, and the candidates of the texts learned from."""

    def __init__(self, lists: Lists, classifier: Classifier, texts: DataFrame, found: DataFrame) -> None:
        self.lists, self.classifier, self._texts, self._found = lists, classifier, texts, found

    def candidates(self, texts: DataFrame) -> DataFrame:
        """``candidates_of``; those of the texts learned from are not looked for again."""
        return self._found if texts is self._texts else candidates_of(texts, self.lists)


#: Separates a candidate's features in one text; white space, so no feature holds it.
_UNIT = "\x1f"
_FOUND = "starts array<int>, ends array<int>, kinds array<string>, votes array<string>, features array<string>, pieces array<string>"


def candidates_of(texts: DataFrame, lists: Lists) -> DataFrame:
    """The other columns of ``texts`` (column ``text``) and the candidates of each text that has any, as parallel arrays.

    One row a text, so that overlapping candidates are settled later without a shuffle.
    """
    keys = [c for c in texts.columns if c != "text"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *key, text, known in batch.itertuples(index=False, name=None):
                if spans := candidates(text, Gazetteer.told(known)):
                    votes = [",".join(map(str, s.votes)) for s in spans]
                    rows.append((*key, [s.start for s in spans], [s.end for s in spans], [s.kind for s in spans], votes, [_UNIT.join(s.features) for s in spans], [text[s.start : s.end] for s in spans]))
            yield pd.DataFrame(rows, columns=[*keys, "starts", "ends", "kinds", "votes", "features", "pieces"])

    source = texts.select(*keys, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    known = _with_known(source, "text", settle(lists.tell(texts), "told"), "known")
    return settle(spread(known).mapInPandas(scan, f"{schema}, {_FOUND}"), "candidates")


def choose(classifier: Classifier, spans: list[Span]) -> list[Span]:
    """The accepted spans, in order, none overlapping another."""
    scored = [(classifier.probability(s.kind, np.array(s.votes), s.features), s) for s in spans]
    taken: list[Span] = []
    for p, s in sorted(scored, key=lambda x: (-round(x[0], 3), x[1].start - x[1].end, x[1].start)):
        if p >= 0.5 and all(s.end <= t.start or t.end <= s.start for t in taken):
            taken.append(s)
    return sorted(taken, key=lambda s: s.start)


def find(text: str, known: Iterable[str] | None, classifier: Classifier) -> list[Span]:
    """The personal data in a text, of whose words so much is known."""
    return choose(classifier, candidates(text, Gazetteer.told(known)))


def sample_of(spans: DataFrame, size: int) -> DataFrame:
    """At most ``size`` candidates, by a hash of where they stand: a context is drawn as often as its share of all."""
    return spans.orderBy(F.xxhash64("row", "start"), "row", "start", "features").limit(size)


def learn(texts: DataFrame, roster: DataFrame, authors: DataFrame) -> Finder:
    """Learns from ``texts`` (column ``text``, not null; read it from a table), a staff list and ``authors`` (column ``author``)."""
    lists = Lists.learn(texts, roster, authors)
    found = candidates_of(texts, lists)
    keys = [c for c in texts.columns if c != "text"]
    each = F.explode(F.arrays_zip("starts", "kinds", "votes", "features")).alias("e")
    spans = found.select(F.xxhash64(*keys).alias("row"), each).select("row", F.col("e.starts").alias("start"), F.col("e.kinds").alias("kind"), "e.votes", "e.features")
    patterns = spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()  # 3 ** LABELERS rows of each type at most
    belief: dict[tuple[str, tuple[int, ...]], float] = {}
    for kind in TYPES:
        rows = sorted((_votes(r["votes"]), r["n"]) for r in patterns if r["kind"] == kind)
        if rows:
            p = reliabilities(np.array([v for v, _ in rows]), np.array([n for _, n in rows]))
            belief |= {(kind, v): float(x) for (v, _), x in zip(rows, p, strict=True)}
    model = Classifier()
    for kind in TYPES:
        sample = sample_of(spans.where(F.col("kind") == kind), TRAINED).collect()
        if sample:
            votes = [_votes(r["votes"]) for r in sample]
            model.fit(kind, [_vector(np.array(v), r["features"].split(_UNIT)) for v, r in zip(votes, sample, strict=True)], np.array([belief[kind, v] for v in votes]))
    return Finder(lists, model, texts, found)


def _votes(text: str) -> tuple[int, ...]:
    return tuple(map(int, text.split(",")))


def find_spans(texts: DataFrame, keys: list[str], finder: Finder) -> DataFrame:
    """keys, pii_type, pii_text: the different pieces of personal data of each text."""
    shared = texts.sparkSession.sparkContext.broadcast(finder.classifier)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *key, starts, ends, kinds, votes, features, pieces in batch.itertuples(index=False, name=None):
                spans = [Span(s, e, k, _votes(v), f.split(_UNIT)) for s, e, k, v, f in zip(starts, ends, kinds, votes, features, strict=True)]
                piece = {(s, e): p for s, e, p in zip(starts, ends, pieces, strict=True)}
                got = {(s.kind, piece[s.start, s.end]) for s in choose(shared.value, spans)}
                rows += [(*key, *g) for g in sorted(got)]
            yield pd.DataFrame(rows, columns=[*keys, "pii_type", "pii_text"])

    found = finder.candidates(texts).select(*keys, *[x.split()[0] for x in _FOUND.split(", ")])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields[: len(keys)])
    return found.mapInPandas(run, f"{schema}, pii_type string, pii_text string")


def redact_columns(df: DataFrame, columns: list[str], finder: Finder) -> DataFrame:
    """``df`` with the personal data in ``columns`` replaced by placeholders such as ``[EMAIL]``."""
    shared = df.sparkSession.sparkContext.broadcast(finder.classifier)

    def redact(text: str | None, known: Iterable[str] | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for s in find(text, known, shared.value):
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
            at = s.end
        return "".join(out) + text[at:]

    @F.pandas_udf(T.StringType())
    def clean(texts: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([redact(t, k) for t, k in zip(texts, known, strict=True)], dtype=object)

    told = settle(finder.lists.tell(df.select(F.explode(F.array(*columns)).alias("text"))), "told")
    out = df
    for i, c in enumerate(columns):
        out = _with_known(out, c, told, f"__known{i}")
    return out.select(*[clean(F.col(c), F.col(f"__known{columns.index(c)}")).alias(c) if c in columns else F.col(c) for c in df.columns])

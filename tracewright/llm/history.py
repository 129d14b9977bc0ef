"""Deduplicating batches against all that was accepted before, by a persisted index of minwise bands.

The index is a folder of Parquet tables that only ever grows, one part per run:

* ``bands``   band key, set id, size and 128 parities of the set, partitioned by a hash bucket of the key;
* ``sets``    set id and shingles, partitioned by a hash bucket of the id. The whole set stands in place
  of a signature: it is the shorter of the two for most texts, and makes the check exact;
* ``keys``    the source keys taken.

What counts is told by the folder alone: a run is part of the index once its marker lies in ``runs``,
which is written last, in one step. So the index can be opened by another process at any time, a run
that died leaves nothing behind, and the last run may be repeated (it replaces itself). ``compact``
merges all runs into one, again in one step.

A run reads only the buckets that its band keys fall into and then only those of the sets it met
(partition filters), checks the candidates' similarity exactly, settles what repeats within the run,
and appends what it accepts. History is never signed again.

A record repeats if its key is taken, or its text is alike to an accepted one, where accepted means
not itself a repetition. Within a run this is decided in rounds over the undecided records: one that
follows an accepted record it repeats is a case; one that follows neither an accepted nor an undecided
one is accepted. Copies and shared keys meet through their set and key, never in pairs.

Cases with a defined result: records with a null or blank key match no key; texts without words are
like nothing; an empty run changes nothing; a run may be repeated only if none was added after it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.bitmap import only
from tracewright.llm.shingles import flat, mix, most_apart, parities, set_id, similarity
from tracewright.sources.scratch import scratch_path, settle

#: Bands and minima per band: a pair at similarity 0.7 is missed with a chance of 1.1e-6.
BANDS, ROWS = 50, 4
#: Buckets of a new index; an index keeps the number it was made with.
BUCKETS = 16
#: New sets of a run that may meet in one band pair by pair; beyond it the run is settled in parts, which is exact too.
HOT = 256
#: Shingles that are signed at a time.
SIGNED = 1 << 15
_SLACK = 1e-9
_ALL = "all"


def _band_keys(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One number per band of each set's minwise signature, a row for each set; no set is empty."""
    salts = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    g, first = grams.view(np.uint64), np.cumsum(sizes) - sizes
    key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(sizes), axis=1)
    for r in range(ROWS):
        least = np.stack([np.minimum.reduceat((g ^ s) * (s | np.uint64(1)), first) for s in salts[r::ROWS]])
        key = mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + least)
    return key.view(np.int64).T


def _signed(batches):  # noqa: ANN001, ANN202
    """x, n, p, q, bands of sets (x, grams): the size, the parities and the bands' keys."""
    for rows in batches:
        n = rows["grams"].map(len).to_numpy()
        for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(np.cumsum(n) // SIGNED)) + 1):  # bounds the memory
            some = rows.iloc[part]
            if len(some):
                grams, sizes = flat(some["grams"])
                p, q = parities(grams, sizes, 128).T
                yield pd.DataFrame({"x": some["x"], "n": sizes, "p": p, "q": q, "bands": list(_band_keys(grams, sizes))})


def _buckets_of(rows: DataFrame) -> list[int]:
    """The different buckets of ``rows``: as many as the index has, at most."""
    return sorted(r[0] for r in rows.select("bucket").distinct().collect())


class _Folder:
    """The files of an index that are no tables: markers of runs, in whatever file system the folder lies."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = path

    def names(self, below: str) -> list[str]:
        """Names in a folder of the index, sorted; none if it is not there."""
        at = self._path(f"{self.path}/{below}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def mark(self, name: str) -> None:
        """Makes an empty file."""
        self._fs.create(self._path(f"{self.path}/{name}"), True).close()

    def drop(self, name: str) -> None:
        """Deletes a file or folder, if it is there."""
        self._fs.delete(self._path(f"{self.path}/{name}"), True)


class History:
    """The index in one folder; opening a folder that holds one continues it."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS) -> None:
        self.spark = spark
        self.path = path or scratch_path(spark, "history")
        self._folder = _Folder(spark, self.path)
        if not (made := self._folder.names("made")):
            self._folder.mark(f"made/{buckets}")
            made = [str(buckets)]
        self.buckets = int(made[0])
        self._open: list[str] = []  # parts of a run that is not committed yet

    def committed(self) -> list[tuple[int, str]]:
        """Number and parts (their count, or "all" for all runs up to it) of the runs that count."""
        runs = [(int(n), parts) for n, _, parts in (name.partition("-") for name in self._folder.names("runs"))]
        base = max((n for n, parts in runs if parts == _ALL), default=-1)
        return [(n, parts) for n, parts in runs if n > base or (n == base and parts == _ALL)]

    def _parts(self) -> list[str]:
        out = []
        for n, parts in self.committed():
            out += [f"{n:08d}-{_ALL}"] if parts == _ALL else [f"{n:08d}-{i}" for i in range(int(parts))]
        return out + self._open

    def _read(self, table: str, schema: str) -> DataFrame:
        have = set(self._folder.names(table))
        paths = [f"{self.path}/{table}/run={p}" for p in self._parts() if f"run={p}" in have]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, run string").option("basePath", f"{self.path}/{table}").parquet(*paths).drop("run")

    def bands(self, buckets: list[int] | None = None) -> DataFrame:
        """band, x, n, p, q, bucket of all accepted sets, or of some buckets."""
        rows = self._read("bands", "band long, x long, n int, p long, q long, bucket int")
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def sets(self, buckets: list[int] | None = None) -> DataFrame:
        """x, grams, bucket of all accepted sets, or of some buckets."""
        rows = self._read("sets", "x long, grams array<long>, bucket int")
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def keys(self) -> DataFrame:
        """The keys taken; one that two runs took stands twice."""
        return self._read("keys", "key string")

    def _bucket(self, c: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(9), c), F.lit(self.buckets)).cast("int").alias("bucket")

    def _bands(self, sets: DataFrame) -> DataFrame:
        """bucket, band, x, n, p, q of each set (x, grams)."""
        keyed = sets.select("x", "grams").mapInPandas(_signed, "x long, n int, p long, q long, bands array<long>")
        return keyed.select("x", "n", "p", "q", F.explode("bands").alias("band")).select(self._bucket("band"), "band", "x", "n", "p", "q")

    def _write(self, table: str, part: str, rows: DataFrame) -> None:
        if "bucket" in rows.columns:
            # Few files a bucket; a bucket too large for a task is split at run time.
            rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{table}/run={part}")
        else:
            rows.write.mode("overwrite").parquet(f"{self.path}/{table}/run={part}")

    def _append(self, part: str, sets: DataFrame, bands: DataFrame, keys: DataFrame) -> None:
        """Writes a part of a run: accepted sets (x, grams), their bands, and keys. Not committed yet."""
        self._write("bands", part, bands.select("bucket", "band", "x", "n", "p", "q"))
        self._write("sets", part, sets.select("x", "grams", self._bucket("x")))
        self._write("keys", part, keys.select("key").where("key is not null").distinct())
        self._open.append(part)

    def _begin(self, number: int | None) -> int:
        """The number of the run to be made; clears what an earlier attempt at it left."""
        last = max((n for n, _ in self.committed()), default=-1)
        number = last + 1 if number is None else number
        if number < last or (number == last and (last, _ALL) in self.committed()):
            raise ValueError("only the last run can be repeated")
        self._open = []
        for name in self._folder.names("runs"):
            if name.startswith(f"{number:08d}-"):
                self._folder.drop(f"runs/{name}")
        return number

    def _commit(self, number: int) -> None:
        self._folder.mark(f"runs/{number:08d}-{len(self._open)}")
        self._open = []

    def compact(self) -> None:
        """Merges all runs into one and deletes the old files; no other process may be reading."""
        runs = self.committed()
        if not runs or (len(runs) == 1 and runs[0][1] == _ALL):
            return
        part = f"{runs[-1][0]:08d}-{_ALL}"
        self._write("bands", part, self.bands())
        self._write("sets", part, self.sets())
        self._write("keys", part, self.keys().distinct())
        self._folder.mark(f"runs/{part}")
        for table in ("bands", "sets", "keys"):
            for name in self._folder.names(table):
                if name != f"run={part}":
                    self._folder.drop(f"{table}/{name}")
        for name in self._folder.names("runs"):
            if name != part:
                self._folder.drop(f"runs/{name}")

    def seed(self, sets: DataFrame, keys: DataFrame) -> None:
        """Takes in what was accepted before the first run: different sets (x, grams) and keys."""
        number = self._begin(None)
        sets = settle(sets, "seed-sets")
        self._append(f"{number:08d}-0", sets, self._bands(sets), keys)
        self._commit(number)

    def run(self, records: DataFrame, threshold: float, number: int | None = None) -> DataFrame:
        """record, is_repeat of each of ``records`` (record, turn, key, grams); accepts the others.

        ``turn`` is a number that orders the records; ``key`` may be null. ``number`` is that of the run
        (the next, if None); the last run's number repeats it. Where many new sets share a band, as when
        a third of a run are edits of one text, the run is cut by turn: the first part is settled, and
        the rest meets what it accepted as history, set by set instead of pair by pair.
        """
        number = self._begin(number)
        done: list[DataFrame] = []
        left: DataFrame | None = records
        hot = HOT
        while left is not None:
            judged, left = self._part(f"{number:08d}-{len(done)}", left, threshold, hot)
            done.append(judged)
            hot *= 2
        self._commit(number)
        out = done[0]
        for x in done[1:]:
            out = out.unionByName(x)
        return out

    def _part(self, part: str, records: DataFrame, threshold: float, hot: int) -> tuple[DataFrame, DataFrame | None]:
        """Judges the records up to the turn at which a band would be met by more than ``hot`` new sets; and what is left."""
        rows = settle(records.withColumn("x", F.when(F.size("grams") > 0, set_id(F.col("grams")))), "run-records")
        sets = settle(rows.where("x is not null").groupBy("x").agg(F.any_value("grams").alias("grams")), "run-sets")
        bands = settle(self._bands(sets), "run-bands")
        rows = rows.select("record", "turn", "key", "x")

        # Against history: the buckets of the run's bands, then the buckets of the sets met there; then exactly.
        # Of history only what has a band of the run is moved.
        old = only(self.bands(_buckets_of(bands)), bands, "band")
        met = settle(self._met(bands, old, threshold).select("x", "y").distinct(), "run-met")
        known = self.sets(_buckets_of(met.select(self._bucket("y")))).select(F.col("x").alias("y"), F.col("grams").alias("y_grams"))
        alike = self._alike(met, sets, known, threshold).select("x").distinct()
        # Records without text or key take no part in these joins.
        by_text = rows.where("x is not null").join(alike, "x", "left_semi").select("record")
        by_key = rows.where("key is not null").join(self.keys(), "key", "left_semi").select("record")
        gone = settle(by_text.unionByName(by_key).distinct(), "run-old")

        # Within the run: only sets that some record not yet a case has.
        fresh = settle(rows.join(gone, "record", "left_anti"), "run-rows")
        new_sets = fresh.select("x").where("x is not null").distinct()
        most = bands.join(new_sets, "x", "left_semi").groupBy("band").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        rest = None
        if most > hot:
            cut = fresh.agg(F.greatest(F.percentile_approx("turn", hot / most), F.min("turn"))).first()[0]
            later = F.col("turn") > F.lit(cut)
            rest = records.join(fresh.where(later).select("record"), "record", "left_semi")
            fresh = fresh.where(~later)
            new_sets = fresh.select("x").where("x is not null").distinct()
        open_bands = bands.join(new_sets, "x", "left_semi")
        met = self._met(open_bands, open_bands, threshold).where("x < y").select("x", "y").distinct()
        own = self._alike(met, sets, sets.select(F.col("x").alias("y"), F.col("grams").alias("y_grams")), threshold)
        links = settle(own.unionByName(own.select(F.col("y").alias("x"), F.col("x").alias("y"))), "run-links")
        cases = settle(self._decide(fresh, links), "run-cases")
        accepted = settle(fresh.join(cases, "record", "left_anti"), "accepted")
        new = accepted.select("x").where("x is not null").distinct()
        self._append(part, sets.join(new, "x", "left_semi"), bands.join(new, "x", "left_semi"), accepted.select("key"))
        repeats = gone.unionByName(cases).select("record", F.lit(True).alias("is_repeat"))
        judged = repeats.unionByName(accepted.select("record", F.lit(False).alias("is_repeat")))
        return judged, rest if rest is None or not rest.isEmpty() else None

    @staticmethod
    def _met(bands: DataFrame, others: DataFrame, threshold: float) -> DataFrame:
        """x, y: the sets that share a band, and differ in no more parities than alike ones may in shingles."""
        others = others.select("band", *[F.col(c).alias(d) for c, d in (("x", "y"), ("n", "o_n"), ("p", "o_p"), ("q", "o_q"))])
        odd = F.bit_count(F.col("p").bitwiseXOR(F.col("o_p"))) + F.bit_count(F.col("q").bitwiseXOR(F.col("o_q")))
        size = F.least("n", "o_n") >= threshold * F.greatest("n", "o_n") - _SLACK
        return bands.join(others, "band").where(size & (odd <= most_apart(F.col("n") + F.col("o_n"), threshold)))

    @staticmethod
    def _alike(met: DataFrame, sets: DataFrame, others: DataFrame, threshold: float) -> DataFrame:
        """Of the candidates (x, y) those whose similarity reaches the threshold."""
        both = met.join(sets.select("x", "grams"), "x").join(others, "y")
        return both.where(similarity(F.col("grams"), F.col("y_grams")) >= threshold - _SLACK).select("x", "y")

    @staticmethod
    def _decide(rows: DataFrame, links: DataFrame) -> DataFrame:
        """The records (of record, turn, key, x) that repeat an accepted one of them; ``links``: alike sets, both ways."""
        # A record's hubs: its key, its set and the sets alike. It stands in the first two, and looks at all.
        stands = rows.select("record", "turn", F.explode(F.array_compact(F.array(F.concat(F.lit("k"), "key"), F.concat(F.lit("x"), F.col("x").cast("string"))))).alias("hub"))
        looks = stands.select("record", "turn", "hub").unionByName(
            rows.join(links, "x").select("record", "turn", F.concat(F.lit("x"), F.col("y").cast("string")).alias("hub"))
        )
        open_ = settle(looks, "open")
        stood = settle(stands, "stands")
        cases: list[DataFrame] = []
        while True:
            # The first undecided record of each hub decides whether others must wait for it.
            first = stood.groupBy("hub").agg(F.min("turn").alias("first"))
            seen = open_.join(first, "hub", "left").groupBy("record", "turn").agg(F.min("first").alias("first"))
            won = settle(seen.where("first is null or first >= turn").select("record"), "won")
            if won.isEmpty():
                break
            taken = stood.join(won, "record", "left_semi").groupBy("hub").agg(F.min("turn").alias("at"))
            lost = settle(open_.join(taken, "hub").where("at < turn").select("record").distinct(), "lost")
            cases.append(lost)
            decided = won.unionByName(lost)
            open_ = settle(open_.join(decided, "record", "left_anti"), "open")
            stood = settle(stood.join(decided, "record", "left_anti"), "stands")
        none = rows.select("record").limit(0)
        for c in cases:
            none = none.unionByName(c)
        return none

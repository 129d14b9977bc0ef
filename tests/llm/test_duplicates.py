import itertools
import random

import numpy as np
import pytest

from tracewright.llm import history as history_module
from tracewright.llm import metric_join
from tracewright.llm.history import BANDS, ROWS, History
from tracewright.llm.metric_join import components, similar_pairs
from tracewright.llm.shingles import shingle_set, shingle_sets

SETS = "x long, grams array<long>"


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def corpus(seed, clusters, size):
    rng = random.Random(seed)
    sets = {}
    for c in range(clusters):
        base = {rng.randrange(10**9) for _ in range(rng.choice([1, 4, 30, 80]))} | {rng.randrange(30) for _ in range(10)}
        for _ in range(size if c == 0 else rng.randint(1, 5)):
            s = {g if rng.random() > 0.08 else rng.randrange(10**9) for g in base}
            sets[len(sets) + 1] = s
    return sets


def pairs_of(spark, sets, t=0.7):
    df = spark.createDataFrame([(x, sorted(s)) for x, s in sets.items()], SETS)
    return {(r.a, r.b): r.similarity for r in similar_pairs(df, t).collect()}


def brute(sets, t=0.7):
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if jaccard(sets[a], sets[b]) >= t - 1e-9}


@pytest.mark.parametrize(("region", "pivots"), [(8, 4), (2, 3)])
def test_all_pairs_are_found(spark, monkeypatch, region, pivots):
    monkeypatch.setattr(metric_join, "REGION", region)  # small: every level of the recursion is used
    monkeypatch.setattr(metric_join, "PIVOTS", pivots)
    sets = corpus(3, 40, 90)
    got = pairs_of(spark, sets)
    assert set(got) == brute(sets)
    assert all(abs(v - jaccard(sets[a], sets[b])) < 1e-9 for (a, b), v in got.items())


def test_the_query_goes_through_pivots(spark, monkeypatch):
    from tracewright.llm.queries_duplicates import p4_found

    rows = []
    split = metric_join._split
    monkeypatch.setattr(metric_join, "_split", lambda regions, *a: rows.append(regions.count()) or split(regions, *a))
    assert p4_found(spark, "/root/testdata/sf0.1").count() > 0
    assert rows and rows[0] > 0


def test_pairs_of_odd_sets(spark):
    assert pairs_of(spark, {1: set(), 2: set(), 3: {5}, 4: {6}}) == {}
    assert pairs_of(spark, {1: set(range(10)), 2: set(range(7)), 3: set(range(6))}).keys() == {(1, 2), (2, 3)}
    assert similar_pairs(spark.createDataFrame([], SETS), 0.7).collect() == []


def test_rare_shingles_rank_first(spark, monkeypatch):
    # Eight unlike sets with 40 common shingles, the least of all, and 60 of their own: nothing is met anywhere.
    rows = {}
    settle = metric_join.settle
    monkeypatch.setattr(metric_join, "settle", lambda df, name, *a: rows.__setitem__(name, settle(df, name, *a)) or rows[name])
    sets = {i: set(range(40)) | {1000 * i + k for k in range(60)} for i in range(1, 9)}
    assert pairs_of(spark, sets) == {}
    assert rows["regions"].count() == 0
    # Two of them alike meet, a set that stands twice counts once.
    twice = spark.createDataFrame([(x, sorted(s)) for x, s in [*sets.items(), (9, sets[1] - {0}), (9, sets[1] - {0})]], SETS)
    assert [(r.a, r.b) for r in similar_pairs(twice, 0.7).collect()] == [(1, 9)]


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(20)], "x long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(12, 15), (15, 11), (9, 9)], "a long, b long")
    got = {r.x: r.component for r in components(nodes, edges).collect()}
    assert got == {i: 0 for i in range(10)} | {10: 10, 11: 11, 12: 11, 13: 13, 14: 14, 15: 11} | {i: i for i in range(16, 20)}
    assert components(nodes, edges.limit(0)).where("x <> component").count() == 0


def test_shingles():
    assert len(shingle_set("A b-c d", 3)) == 2
    assert len(shingle_set("one two", 3)) == 1 and len(shingle_set("... é", 3)) == 0
    assert np.array_equal(shingle_set("a b c", 3), shingle_set("A, B; c!", 3))
    assert len(np.intersect1d(shingle_set("a b", 3), shingle_set("a b b", 3))) == 0
    assert len(shingle_set("w " * 100_000 + "end", 3)) == 2


def test_shingles_of_many_texts():
    texts = [None, "", "a", "B a", "... é", "K x İ y", "w " * 100_000 + "end", "x" * 300_000 + " y z", "a b c d a b c"]
    got = shingle_sets(texts, 3)
    assert [len(g) for g in got] == [0, 0, 1, 1, 0, 2, 2, 1, 4]
    assert all(np.array_equal(g, shingle_set(t or "", 3)) and (g[1:] > g[:-1]).all() for t, g in zip(texts, got, strict=True))


def greedy(old, keys, records, t=0.7):
    accepted, taken, out = [s for s in old if s], set(keys), {}
    for rec, key, s in records:
        hit = (key is not None and key in taken) or (bool(s) and any(jaccard(s, o) >= t - 1e-9 for o in accepted))
        out[rec] = hit
        if not hit:
            if s:
                accepted.append(s)
            if key is not None:
                taken.add(key)
    return out


@pytest.mark.parametrize("hot", [256, 3])
def test_runs_give_what_one_by_one_gives(spark, monkeypatch, hot):
    monkeypatch.setattr(history_module, "HOT", hot)  # small: runs are cut in parts
    rng = random.Random(7)
    sets = [set(s) for s in corpus(9, 60, 40).values()]
    rng.shuffle(sets)
    old, new = sets[:40], sets[40:]
    records = []
    for i, s in enumerate(new * 2):
        key = rng.choice([None, None, f"k{rng.randrange(30)}"])
        records.append((i, key, s if rng.random() > 0.05 else set()))
    history = History(spark)
    distinct = {tuple(sorted(s)): s for s in old}
    history.seed(spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(distinct.values())], SETS).selectExpr("xxhash64(grams) as x", "grams"), spark.createDataFrame([("k1",), (None,)], "key string"))
    got = {}
    third = len(records) // 3
    for part in (records[:third], records[third : third + 1], [], records[third + 1 :]):
        df = spark.createDataFrame([(r, r, k, sorted(s)) for r, k, s in part], "record long, turn long, key string, grams array<long>")
        got |= {r.record: r.is_repeat for r in history.run(df, 0.7).collect()}
    assert got == greedy(old, {"k1"}, records)


def _records(spark, rows):
    return spark.createDataFrame(rows, "record long, turn long, key string, grams array<long>")


def test_an_index_is_continued_by_who_opens_it(spark, tmp_path):
    text = list(range(20))
    first = History(spark, f"{tmp_path}/h", buckets=8)
    first.seed(spark.createDataFrame([(1, text)], SETS).selectExpr("xxhash64(grams) as x", "grams"), spark.createDataFrame([("k1",)], "key string"))
    judged = lambda h, rows, **kw: {r.record: r.is_repeat for r in h.run(_records(spark, rows), 0.7, **kw).collect()}
    again = History(spark, f"{tmp_path}/h")
    assert again.buckets == 8 and again.committed() == [(0, "1")]
    rows = [(1, 1, "k1", [900]), (2, 2, None, text[:18]), (3, 3, "k2", list(range(100, 120))), (4, 4, None, []), (5, 5, None, None)]
    want = {1: True, 2: True, 3: False, 4: False, 5: False}
    assert judged(again, rows) == want
    # The last run repeats itself, and does not meet what it had accepted; an earlier one is refused.
    assert judged(History(spark, f"{tmp_path}/h"), rows, number=1) == want
    with pytest.raises(ValueError, match="last run"):
        again.run(_records(spark, rows), 0.7, number=0)
    # A run that died before its marker counts for nothing.
    dead = History(spark, f"{tmp_path}/h")
    dead._append("00000002-0", spark.createDataFrame([(7, [555])], SETS), dead._bands(spark.createDataFrame([(7, [555])], SETS)), spark.createDataFrame([("k9",)], "key string"))
    later = [(6, 6, "k9", [555]), (7, 7, "k2", None), (8, 8, None, list(range(100, 119)))]
    assert judged(History(spark, f"{tmp_path}/h"), later) == {6: False, 7: True, 8: True}
    whole = History(spark, f"{tmp_path}/h")
    before = sorted(r.x for r in whole.sets().collect())
    whole.compact()
    opened = History(spark, f"{tmp_path}/h")
    assert opened.committed() == [(2, "all")] and sorted(r.x for r in opened.sets().collect()) == before
    assert judged(opened, [(9, 9, "k9", None), (10, 10, None, [555]), (11, 11, None, [556])]) == {9: True, 10: True, 11: False}


def test_a_run_reads_only_the_buckets_it_meets(spark, tmp_path):
    history = History(spark, f"{tmp_path}/h", buckets=16)
    history.seed(spark.createDataFrame([(i, [i]) for i in range(200)], SETS), spark.createDataFrame([], "key string"))
    files = lambda df: {f.split("bucket=")[1].split("/")[0] for f in df.inputFiles()}
    plan = history.bands([3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.bucket for r in history.bands([3, 5]).select("bucket").distinct().collect()} <= {3, 5}
    assert len(files(history.bands())) == 16


def test_batches_in_one_run_or_each_alone(spark):
    from tracewright.llm import queries_duplicates as Q

    rows = lambda n: sorted((r.import_id, str(r.is_repeat)) for r in Q._judged(spark, "/root/testdata/sf0.001", n).collect())
    assert rows(25) == rows(1)


def test_runs_grow_with_what_came_before():
    from tracewright.llm import queries_duplicates as Q

    batches = [(i, 400) for i in range(2500)]
    assert Q._runs(batches, 1_400_000) == [(0, 2499)]
    runs = Q._runs(batches, 10_000)
    assert len(runs) < 10 and runs[0] == (0, 24) and runs[-1][1] == 2499
    assert [b for first, last in runs for b in range(first, last + 1)] == list(range(2500))
    assert Q._runs([], 5) == []


def test_unlike_sets_that_share_a_band_are_not_compared(spark, monkeypatch):
    rows = {}
    settle = history_module.settle
    monkeypatch.setattr(history_module, "settle", lambda df, name, *a: rows.__setitem__(name, settle(df, name, *a)) or rows[name])
    text = lambda i: list(range(40)) + [1000 * i + k for k in range(60)]
    history = History(spark)
    history.seed(spark.createDataFrame([(i, text(i)) for i in range(1, 31)], SETS), spark.createDataFrame([], "key string"))
    new = [(i, i, None, text(i)) for i in range(31, 61)] + [(61, 61, None, text(1)[1:]), (62, 62, None, text(31)[1:])]
    judged = {r.record: r.is_repeat for r in history.run(_records(spark, new), 0.7).collect()}
    assert judged == {r[0]: r[0] > 60 for r in new}
    assert rows["run-met"].count() == 1


def test_bands_miss_hardly_any_pair_at_the_threshold():
    assert (1 - 0.7**ROWS) ** BANDS < 2e-6


def test_p4_query_against_brute_force(spark):
    DATA = "/root/testdata/sf0.001"
    from tracewright.llm.queries_duplicates import p4_found, p4_groups
    from tracewright.operators.current import current_rows
    from tracewright.sources.tables import load

    rows = current_rows(load(spark, DATA, "fixes"), ["id", "issue", "resolution", "error_excerpt"]).collect()
    sets = {r.id: set(shingle_set(" ".join(x or "" for x in (r.issue, r.resolution, r.error_excerpt)), 3).tolist()) for r in rows}
    want = brute(sets)
    assert {(r.id_a, r.id_b) for r in p4_found(spark, DATA).collect()} == want
    groups = {r.id: r.group_id for r in p4_groups(spark, DATA).collect()}
    assert groups.keys() == sets.keys() and all(groups[a] == groups[b] for a, b in want)

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import mixing, packing
from tracewright.llm.splitting import Splitter, parse, split_texts
from tracewright.llm.tokens import PATTERN, bpe, token_count, vocabulary_path

MODEL = bpe(vocabulary_path())
TEXTS = ["", "a", "don't 's '' ','x ,,'", "a  b\n\n  c \t d\r\n", "日本語　テスト。次", "😀 hi 𝒳𝒴", "x²³5² ①", "a\x1cb", " │ Error: aws_vpc.x_1[0]", "é" * 50, "--'--'a'll"]


@pytest.mark.parametrize("text", TEXTS)
def test_count_is_exact(text):
    assert MODEL.count(text) == len(MODEL._encoding.encode_ordinary(text))


@given(st.text(st.characters(blacklist_categories=("Cs",)), max_size=80) | st.text(alphabet="ab '.,-9\n\t é│", max_size=60))
@settings(max_examples=500, deadline=None)
def test_count_and_ends_agree_with_the_tokenizer(text):
    ids = MODEL._encoding.encode_ordinary(text)
    assert MODEL.count(text) == len(ids)
    ends = MODEL.ends(text)
    assert len(ends) == len(ids) and (not text or ends[-1] == len(text))


def test_count_column(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",)], "text string")
    assert [r[0] for r in df.select(token_count(vocabulary_path())("text")).collect()] == [2, 0, 0]
    assert PATTERN


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 400), max_size=30))
@settings(max_examples=200, deadline=None)
def test_plan_uses_every_item_and_keeps_to_the_capacity(counts):
    used = {}
    for p in packing.plan(counts, 50):
        assert sum(p.lengths) <= 50 and p.copies > 0
        for x in p.lengths:
            used[x] = used.get(x, 0) + p.copies
    assert used == counts


def test_exact_complements_are_found():
    assert [(p.lengths, p.copies) for p in packing.plan({90: 2, 10: 1, 7: 1, 3: 1}, 100)] == [((90, 10), 1), ((90, 7, 3), 1)]


def packed(spark, sizes, capacity):
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, tokens int")
    return packing.pack(items, capacity).collect()


def check_packed(rows, sizes, capacity):
    total = {}
    at = {}
    for r in rows:
        total[r.item] = total.get(r.item, 0) + r.length
        if r.length:
            at.setdefault(r.container, []).append((r.offset, r.offset + r.length))
    assert total == {i: s or 0 for i, s in enumerate(sizes)}
    for spans in at.values():
        spans.sort()
        assert spans[-1][1] <= capacity and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    cut = {r.item for r in rows if r.piece > 1}
    assert cut == {i for i, s in enumerate(sizes) if (s or 0) > capacity and (s % capacity or s > capacity)}
    return len(at)


def test_pack(spark, monkeypatch):
    rng = random.Random(1)
    sizes = [rng.choice([0, 1, 5, 17, 40, 63, 64, 65, 128, 300]) for _ in range(600)] + [None, 40, 40]
    best = check_packed(packed(spark, sizes, 64), sizes, 64)
    assert best <= -(-sum(s or 0 for s in sizes) // 64) * 1.05
    monkeypatch.setattr(packing, "RANKED_AT_ONCE", 20)  # a hot length in many salts
    hot = [13] * 500 + [38] * 500
    check_packed(packed(spark, hot, 64), hot, 64)
    assert packed(spark, [], 64) == []
    check_packed(packed(spark, [0, 0], 64), [0, 0], 64)


def mixed(spark, sizes, sources):
    rows = [(i, s, n) for i, (s, n) in enumerate(sizes)]
    return mixing.draw(spark.createDataFrame(rows, "doc_id long, source string, tokens int"), sources, [round(w * mixing.largest_budget(sources)) for w in mixing.weights(sources, 1.0)], 3).collect()


def test_mixture_reaches_shares_within_repeats(spark):
    rng = random.Random(2)
    sizes = [(rng.choice(["a", "a", "a", "b", "c"]), rng.randint(1, 900)) for _ in range(4000)] + [("b", 0), ("z", 5)]
    df = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes)], "doc_id long, source string, tokens int")
    targets = spark.createDataFrame([(" A", 0.3, 1), ("b", 0.5, 3), ("C ", 0.2, 2), ("none", 0.4, 1)], "source string, target_share double, max_repeats int")
    sources = mixing.offered(df, targets)
    assert [s.name for s in sources] == ["a", "b", "c"] and abs(sum(s.target for s in sources) - 1) < 1e-9
    got = mixed(spark, sizes, sources)
    total = sum(r.tokens for r in got)
    for s in sources:
        own = [r for r in got if r.source == s.name]
        assert abs(sum(r.tokens for r in own) / total - s.target) < 0.001
        assert max(r.use for r in own) <= s.max_repeats
    assert len({(r.doc_id, r.use) for r in got}) == len(got)


def test_exponent_meets_the_repetition_limit_or_entropy():
    sources = [mixing.Source("big", 900, 9, 0.5, 1), mixing.Source("small", 100, 9, 0.5, 2)]
    a, w = mixing.solve(sources, 800)
    assert 0 < a < 1 and w[1] * 800 == pytest.approx(200, abs=1)
    assert mixing.solve(sources, 100)[0] == 1.0
    a, w = mixing.solve(sources, 100, target_entropy=0.5)
    assert mixing.entropy(w) == pytest.approx(0.5, abs=1e-6)


def test_mixture_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, tokens int")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    sources = mixing.offered(df, targets)
    assert sources == [] and mixing.largest_budget(sources) == 0
    assert mixing.draw(df, sources, []).collect() == []


def pieces_of(text, limit, overlap):
    s = Splitter(MODEL, limit, overlap)
    out = s.split(text)
    if text:
        edges = [p.natural_start for p in out] + [len(text)]
        assert edges == sorted(edges) and edges[0] == 0
        assert all(p.end == e and p.start <= p.natural_start for p, e in zip(out, edges[1:], strict=True))
        assert all(MODEL.count(text[p.start : p.end]) == p.tokens <= limit for p in out)
    return out


def test_split_at_headings_first():
    text = "".join(f"# Part {i}\n\n" + "Some words here. " * 30 + "\n\n" for i in range(4))
    out = pieces_of(text, 200, 0)
    assert [p.level for p in out] == ["text", "h1", "h1", "h1"]
    assert all(text[p.start :].startswith("# Part") for p in out)


def test_overlap_is_kept():
    text = "\n".join(f"line {i} of the log" for i in range(400))
    out = pieces_of(text, 128, 16)
    for p in out[1:]:
        assert p.overlap == 16 and 14 <= MODEL.count(text[p.start : p.natural_start]) <= 18
        assert text[p.natural_start - 1] == "\n"


@pytest.mark.parametrize("text", ["x" * 30_000, "日本語" * 3000, "a b " * 4000, '{"a":1,"b":[2,3]},' * 1500, "\n" * 9000, "😀" * 3000, "ab12" * 5000])
def test_texts_without_structure(text):
    out = pieces_of(text, 256, 32)
    assert len(out) > 1


@given(st.text(alphabet="ab#-. \n`日é😀1,", max_size=400))
@settings(max_examples=100, deadline=None)
def test_any_text_is_covered(text):
    pieces_of(text, 24, 4)


def kinds(text):
    def show(n):
        return (n.kind, text[n.start : n.end].strip().split("\n")[0], [show(c) for c in n.children]) if n.children else (n.kind, text[n.start : n.end].strip().split("\n")[0])

    def check(n):
        if n.children:
            assert n.children[0].start == n.start and n.children[-1].end == n.end
            assert all(a.end == b.start for a, b in itertools.pairwise(n.children))
            for c in n.children:
                check(c)

    tree = parse(text)
    check(tree)
    return show(tree)


def test_fences_hide_headings_items_and_empty_lines():
    text = "# A\n\nintro\n\n```sh\n# no heading\n\n- no item\n```\n\n## B\n\ntext\n"
    tree = kinds(text)
    seen = []

    def walk(n):
        seen.append(n[:2])
        for c in n[2] if len(n) > 2 else []:
            walk(c)

    walk(tree)
    assert ("fence", "```sh") in seen and ("h2", "## B") in seen
    assert not any("no heading" in x or "no item" in x for _, x in seen)


def test_lists_nest_by_indentation():
    text = "- one\n  - inner a\n  - inner b\n\n    more of b\n- two\n"
    tree = kinds(text)
    items = tree[2][0][2] if tree[2][0][0] != "item" and len(tree[2]) == 1 else tree[2]
    assert [i[1] for i in items] == ["- one", "- two"]
    assert any("- inner b" in str(i) for i in items[0][2])


def test_small_siblings_are_merged_and_large_ones_entered():
    text = "# A\n\nshort\n\n# B\n\nshort too\n\n# C\n\n" + "\n\n".join(f"Paragraph {i}. " + "Words go on here. " * 20 for i in range(6)) + "\n\n# D\n\nend\n"
    out = pieces_of(text, 200, 0)
    assert text[out[1].start :].startswith("# C") and out[1].level == "h1"
    assert text[out[-1].start :].startswith("# D")
    assert {p.level for p in out[2:-1]} == {"block"}


def test_split_texts_column(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "word " * 3000), (4, "word " * 3000)], "doc_id long, text string")
    got = split_texts(df, [(3, 512, 64)], vocabulary_path()).collect()
    assert {r.doc_id for r in got} == {3, 4}
    assert len([r for r in got if r.doc_id == 4]) == 2 * next(r.pieces for r in got if r.doc_id == 4)

import hashlib

import numpy as np
import pytest

from tracewright.llm.pii import Classifier, Lists, _vector, learn, find_spans, redact_columns, reliabilities, sample_of
from tracewright.llm.pii_spans import Gazetteer, candidates

GAZ = Gazetteer({"norela", "wenette", "oskis", "norick", "wenick"}, {"quillane", "dunnleway", "quilleway", "dunnane"}, {"oster vale"})


def test_reliabilities_tell_good_labelers_from_noise():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.3
    votes = np.stack([np.where(rng.random(20_000) < q, np.where(truth, 1, -1), np.where(truth, -1, 1)) for q in (0.95, 0.9, 0.85, 0.5)], axis=1)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p = reliabilities(patterns, counts)
    assert ((p[inverse.ravel()] > 0.5) == truth).mean() > 0.95


def test_classifier_learns_probabilities():
    rows = [_vector(np.array([1, 0, 1, 0, 0]), ["a"]), _vector(np.array([-1, 0, 0, 0, -1]), ["b"])] * 50
    c = Classifier()
    c.fit("x", rows, np.array([0.95, 0.05] * 50))
    assert c.probability("x", np.array([1, 0, 1, 0, 0]), ["a"]) > 0.8 > 0.2 > c.probability("x", np.array([-1, 0, 0, 0, -1]), ["b"])
    assert c.probability("unknown", np.array([1, 1, 1, 1, 1]), []) == 0


@pytest.mark.parametrize(
    ("text", "kind", "piece"),
    [
        ("Ask norela.quillane+x@team.works.example before", "email", "norela.quillane+x@team.works.example"),
        ("Contact: o_x [at] stacks [dot] invalid.", "email", "o_x [at] stacks [dot] invalid"),
        ("mail oskis at ops dot example now", "email", "oskis at ops dot example"),
        ("Call +44 (0)20 7946 0128 if", "phone", "+44 (0)20 7946 0128"),
        ("tel:(299) 555-0147\n", "phone", "(299) 555-0147"),
        ("under 12055550120.", "phone", "12055550120"),
        ("my NINO (QQ598409B).", "id_number", "QQ598409B"),
        ('holder_ssn="923182571" x', "id_number", "923182571"),
        ("goes to 16b Copperbeck Road.", "street_address", "16b Copperbeck Road"),
        ("at Flat 2, 3c Hollin Court, Fenwick Hollow, QQ5 0XV; b", "street_address", "Flat 2, 3c Hollin Court, Fenwick Hollow, QQ5 0XV"),
        ("to 92 Old Kiln Ave., Apt 18, Oster Vale.", "street_address", "92 Old Kiln Ave., Apt 18, Oster Vale"),
        ("to 58, rue Three Wells, 00009 Oster Vale.", "street_address", "58, rue Three Wells, 00009 Oster Vale"),
        ("to 28 Wren St\nOster Vale 00003.", "street_address", "28 Wren St\nOster Vale 00003"),
        ("Spoke to Norela B. Quillane about", "person_name", "Norela B. Quillane"),
        ("Dr. van der O'Quillane said", "person_name", "van der O'Quillane"),
        ("Reviewed: Dunnleway, Oskis", "person_name", "Dunnleway, Oskis"),
        ("W. Quillane's laptop", "person_name", "W. Quillane"),
        ('user="norela quillane" op', "person_name", "norela quillane"),
        ("NORELÁ QUILLANE-DUNNLEWAY x", "person_name", "NORELÁ QUILLANE-DUNNLEWAY"),
    ],
)
def test_candidates(text, kind, piece):
    assert piece in [text[s.start : s.end] for s in candidates(text, GAZ) if s.kind == kind]


TEXTS = [
    ("Spoke to Norela Quillane about x-{i}. Call +44 7700 9{i:05d} if it pages.", {("person_name", "Norela Quillane")}),
    ("Ask oskis.dunnleway@ops.example before you apply. Helm Chart was pinned to {i}.", {("email", "oskis.dunnleway@ops.example")}),
    ("Cloned from git@code-{i}.invalid:infra/x.git at 3122f0c1. Account 0079924{i:05d} is affected.", set()),
    ("The form held SSN 936-36-0{i:03d} in clear text. Build 972-47-1{i:03d} was green.", set()),
]


def test_found_and_redacted(spark):
    rows = [(j * 100 + i, t.format(i=i)) for i in range(60) for j, (t, _) in enumerate(TEXTS)] + [(9000, ""), (9001, "word " * 30_000 + "Ask oskis.dunnleway@ops.example before")]
    df = spark.createDataFrame(rows, "seq long, text string")
    roster = spark.createDataFrame([("Norela", "Quillane"), ("Oskis", "Dunnleway")], "given_name string, family_name string")
    finder = learn(df, roster, spark.createDataFrame([(None,), ("Norela Quillane",)], "author string"))
    got = {}
    for r in find_spans(df, ["seq"], finder).collect():
        got.setdefault(r.seq, set()).add((r.pii_type, r.pii_text))
    assert got[7] == {("person_name", "Norela Quillane"), ("phone", "+44 7700 900007")}
    assert got[107] == {("email", "oskis.dunnleway@ops.example")} == got[9001]
    assert 207 not in got and got[307] == {("id_number", "936-36-0007")}
    plain = spark.createDataFrame([(1, TEXTS[0][0].format(i=7), None), (2, None, "")], "seq long, text string, notes string")
    out = redact_columns(plain, ["text", "notes"], finder).orderBy("seq").collect()
    assert out[0].text == "Spoke to [PERSON_NAME] about x-7. Call [PHONE] if it pages." and out[0].notes is None
    assert out[1].text is None and out[1].notes == ""


def test_no_texts(spark):
    none = spark.createDataFrame([], "seq long, text string")
    finder = learn(none, spark.createDataFrame([], "given_name string, family_name string"), spark.createDataFrame([], "author string"))
    assert find_spans(none, ["seq"], finder).collect() == []


def test_words_met_once_are_listed(spark):
    rows = [(j * 100 + i, t.format(i=i)) for i in range(30) for j, (t, _) in enumerate(TEXTS)]
    rows += [(8000 + i, f"It ships to {i + 2} Wren Street, 0000{i % 9} Fenwick Hollow.") for i in range(30)]
    rows += [(9000, "It ships to 28 Wren Street, 00003 Oster Vale."), (9001, "It goes to 16b Copperbeck Road, Oster Vale."), (9002, "Ask wenette.quillrow@ops.example before"), (9003, 'user="wenette quillrow" op')]
    df = spark.createDataFrame(rows, "seq long, text string")
    finder = learn(df, spark.createDataFrame([("Norela", "Quillane")], "given_name string, family_name string"), spark.createDataFrame([], "author string"))
    got = {(r.seq, r.pii_text) for r in find_spans(df, ["seq"], finder).collect()}
    assert {(9001, "16b Copperbeck Road, Oster Vale"), (9003, "wenette quillrow")} <= got


def test_each_text_is_told_all_it_asks(spark):
    given, family, towns = ["norela", "wenette", "oskis", "norick", "wenick"], ["quillane", "dunnleway", "quilleway", "dunnane"], ["oster vale"]
    texts = [
        "Spoke to Norela B. Quillane and Wenela Dunneway-O'Quillane's friend, NORELÁ DUNNLEWAY; norette quillleway",
        "mail xnorela-o'quillane+a@ops.example or wquillane at ops dot example about Quillane, Oskis",
        "to 92 Old Kiln Ave., Apt 18, Oster Vale Site. and 3 Wren Street, Oster Mere",
        "nothing here",
    ]
    post = [(f"It ships to 28 Wren Street, 00003 {t.title()}.",) for t in towns]
    roster = spark.createDataFrame([(g, family[i % 4].title()) for i, g in enumerate(given)], "given_name string, family_name string")
    lists = Lists.learn(spark.createDataFrame(post, "text string"), roster, spark.createDataFrame([], "author string"))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    told = {bytes(r.digest): r.known for r in lists.tell(df).collect()}
    whole = Gazetteer(set(given), set(family), set(towns))
    for t in texts:
        own = candidates(t, Gazetteer.told(told.get(hashlib.sha256(t.encode()).digest())))
        assert [(s.start, s.end, s.kind, s.votes) for s in own] == [(s.start, s.end, s.kind, s.votes) for s in candidates(t, whole)]
    assert {"g1norela", "f2quillane", "f0dunneway", "t1oster vale"} <= {k for v in told.values() for k in v}


def test_sample_is_of_rows_not_of_contexts(spark):
    rows = [(i * 7919, 3, [1, 0], ["b1=common" if i % 10 else "b1=rare"]) for i in range(2000)]
    spans = spark.createDataFrame(rows, "row long, start int, votes array<int>, features array<string>")
    drawn = [r.features[0] for r in sample_of(spans, 500).collect()]
    assert len(drawn) == 500 and 20 <= drawn.count("b1=rare") <= 90


@pytest.mark.parametrize("piece", ["oskis[AT]ops[DOT]example", "oskis{at}ops.example", "oskis (At) ops.example", "oskis\tat\nops dot example"])
def test_every_spelling_of_at_is_looked_at(piece):
    assert piece in [t[s.start : s.end] for t in [f"mail {piece} now"] for s in candidates(t, GAZ) if s.kind == "email"]


def test_a_title_is_no_part_of_a_name():
    from tracewright.llm.pii_spans import Gazetteer, candidates

    text = "As Prof. Dunnleway said, As Dr Wickucci said. Miss Norela Quillane came."
    found = {text[s.start : s.end] for s in candidates(text, Gazetteer({"norela"}, {"quillane", "dunnleway", "wickucci"}, set())) if s.kind == "person_name"}
    assert found == {"Dunnleway", "Wickucci", "Norela Quillane"}

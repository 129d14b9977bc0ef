import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.operators.tags import SEPARATORS, explode_packed, tokenize

CASES = [
    (None, []),
    ("", []),
    (" \t ", []),
    (",;|", []),
    ("a,b;c|d\te\r\nf，g；h、i", list("abcdefghi")),
    ("a | b , c", ["a", "b", "c"]),
    ("core infra", ["core", "infra"]),
    ("core infra,x", ["core infra", "x"]),
    ('"core infra" x', ["core infra", "x"]),
    ('["dev|qa", "size 5\\" rack"]', ["dev|qa", 'size 5" rack']),
    ('a,"size 5"" rack",b', ["a", 'size 5" rack', "b"]),
    ("'the \"slow\" path',k8s", ['the "slow" path', "k8s"]),
    ("{helm, don't page}", ["helm", "don't page"]),
    ("dev\\|qa|x", ["dev|qa", "x"]),
    ("kw:iam,env=prod,ci/cd,on-call", ["kw:iam", "env=prod", "ci/cd", "on-call"]),
    ('"abc, d', ['"abc', "d"]),
    ("x[0,1],y", ["x[0,1]", "y"]),
    ("[a, [b, c]]", ["a", "b", "c"]),
    ("A,a,A", ["A", "a", "A"]),
    ('" padded ",x', ["padded", "x"]),
    ('["caf\\u00e9"]', ["café"]),
    ('aws_vpc kw:role "east; west"', ["aws_vpc", "kw:role", "east; west"]),
    ('"dev|qa"  infra  "a, b"', ["dev|qa", "infra", "a, b"]),
    ("infra 'on call; weekly'", ["infra", "on call; weekly"]),
    ('say "hi, there",x', ['say "hi', 'there"', "x"]),
    ('5" rack dev', ['5"', "rack", "dev"]),
]


@pytest.mark.parametrize(("field", "values"), CASES)
def test_tokenize(field, values):
    assert tokenize(field) == values


@given(st.lists(st.text(st.characters(blacklist_characters="\\\x1f", blacklist_categories=("Cs",)), min_size=1, max_size=8), max_size=6), st.sampled_from(",;|、"))
@settings(max_examples=200, deadline=None)
def test_quoted_values_come_back(values, separator):
    field = separator.join('"' + v.replace('"', '""') + '"' for v in values)
    assert tokenize(field) == [s for v in values if (s := v.strip())]


@given(st.text(alphabet="ab \"'\\[]{}" + SEPARATORS, max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_text_ends_and_has_no_blank_values(field):
    assert all(v == v.strip() and v for v in tokenize(field))


def test_explode_keeps_columns_and_repeats(spark):
    df = spark.createDataFrame([(1, "a,b,a", "x", 9), (1, "a,b,a", "x", 9), (2, None, "y", 9), (3, "q" * 100_000 + ",z", None, 9)], "seq long, tags string, tag string, pos int")
    got = explode_packed(df, "tags").collect()
    assert sorted((r.seq, r.pos, r.tag[:3]) for r in got) == [(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (1, 3, "a"), (1, 3, "a"), (3, 1, "qqq"), (3, 2, "z")]
    assert explode_packed(df.limit(0), "tags").count() == 0

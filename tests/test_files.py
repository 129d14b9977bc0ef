import json

from tracewright.sources import files

FIX = dict(id="abcdef12-1", issue="i1\nsecond", resolution="r", error_excerpt="Error: x", tags="a,b", notes="n", created_at="2024", updated_at="2025", author="A", author_email="a@b.c", is_private=None)


def test_fix_store(spark, tmp_path):
    (tmp_path / "db.json").write_text(json.dumps([FIX, {"id": "x"}, dict(FIX, id="zz", notes=None)]))
    (tmp_path / "bad.json").write_text("[{")
    fixes = files.read_fixes(spark, str(tmp_path / "db.json"))
    assert sorted(r.id for r in fixes.collect()) == ["abcdef12-1", "zz"]
    assert files.read_fixes(spark, str(tmp_path / "bad.json")).count() == 0
    back = files.from_markdown(files.to_markdown(fixes))
    same = [c for c in back.columns]
    assert sorted(map(str, back.collect())) == sorted(map(str, fixes.select(same).collect()))
    new = spark.createDataFrame([dict(FIX, issue="changed")], files.FIX_SCHEMA)
    assert {r.id: r.issue for r in files.upsert_fixes(fixes, new).collect()} == {"abcdef12-1": "changed", "zz": "i1\nsecond"}
    assert files.delete_by_prefix(fixes, "ABC").count() == 1
    patch = spark.createDataFrame([("zz", "", "better")], "id string, issue string, resolution string")
    got = {r.id: r for r in files.edited(fixes, patch, "now").collect()}
    assert (got["zz"].issue, got["zz"].resolution, got["zz"].updated_at, got["abcdef12-1"].updated_at) == ("i1\nsecond", "better", "now", "2025")


def test_ticket_csv_and_json(spark, tmp_path):
    (tmp_path / "t.csv").write_text('﻿Key;Summary\nA-1; one \nA-2;"two; and\nthree"\n')
    got = files.read_ticket_csv(spark, str(tmp_path / "t.csv"))
    assert got.columns == ["key", "summary"] and [tuple(r) for r in got.collect()] == [("A-1", "one"), ("A-2", "two; and\nthree")]
    for i, text in enumerate(['[{"k":1},{"k":2}]', '{"issues":[{"k":1},{"k":2}]}', '{"records":[{"k":1}]}', '{"k":5}', "broken"]):
        (tmp_path / f"{i}.json").write_text(text)
    count = [files.read_ticket_json(spark, str(tmp_path / f"{i}.json")).count() for i in range(5)]
    assert count == [2, 2, 1, 1, 0]


def test_dot(spark, tmp_path):
    (tmp_path / "g.dot").write_text('digraph {\n"[root] a.b (expand)" -> "[root] provider[\\"x\\"] (close)"\n"a" -> "b";\n"a" -> "b"\n"n" [label="n"]\n}\n')
    assert sorted(map(tuple, files.read_dot(spark, str(tmp_path / "g.dot")).collect())) == [("a", "b"), ("a.b", 'provider["x"]')]

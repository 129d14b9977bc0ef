import datetime
import decimal
import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from conftest import DATA
from tracewright.plans import registry
from tracewright.functions.text import instant_us
from tracewright.operators.graph import reached

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_instants(spark):
    same = ["2024-06-11T12:43:15.922466-05:00", "2024-06-11 17:43:15.922466+00:00", "2024-06-11T17:43:15.922466", " 2024-06-11T17:43:15.922466Z ", "2024-06-11T17:43:15.922466+0000"]
    rows = spark.createDataFrame([(x,) for x in [*same, "", None, "soon", "2024-06-11"]], "t string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [r[0] for r in rows.select(instant_us(rows["t"])).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert len(set(got[:5])) == 1 and got[0] is not None and got[5:8] == [None] * 3 and got[8] == 1718064000000000


def test_cycles_end(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "c")], "src string, dst string")
    got = reached(edges, spark.createDataFrame([("a",)], "node string"), 9)
    assert sorted((r.node, r.depth, r.via) for r in got.collect()) == [("b", 1, "a"), ("c", 2, "b"), ("d", 3, "c")]


def test_works_without_the_text_subpackage(tmp_path):
    import subprocess
    import sys

    code = "import sys; sys.modules['tracewright.llm']=None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p4_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

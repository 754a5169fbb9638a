"""Every core query runs, and those with SQL agree with it, on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from tidemark.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 7) + 0.0
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return str(list(map(plain, v))) if isinstance(v, (list, tuple)) else str(v) if isinstance(v, datetime.date) else v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(data):
        c.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    if name in SQL:
        res = duck.execute(SQL[name])
        names = [d[0] for d in res.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_the_core_does_not_import_the_text_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(f"{root}/tidemark"):
        if "/llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    assert "tidemark.llm" not in open(f"{folder}/{f}").read(), f

"""Every query of the subpackage runs, and those with SQL agree with it, on the smallest tables."""

import os

import duckdb
import pytest

from tidemark.llm import queries

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    got = df.collect()
    if name in SQL:
        c = duckdb.connect()
        c.execute("set timezone = 'UTC'")
        for f in os.listdir(data):
            c.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
        res = c.execute(SQL[name])
        names = [d[0] for d in res.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(tuple(r[n] for n in names) for r in got) == sorted(res.fetchall())

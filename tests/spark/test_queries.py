import os

import duckdb
import pytest

from siltstone import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.partition('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, DATA)
    rows = sorted((tuple(r[c] for c in sorted(got.columns)) for r in got.collect()), key=repr)
    assert rows
    if name in queries.ORACLE_SQL:
        found = con.execute(queries.ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(got.columns)
        order = [names.index(c) for c in sorted(names)]
        assert rows == sorted((tuple(r[k] for k in order) for r in found.fetchall()), key=repr)

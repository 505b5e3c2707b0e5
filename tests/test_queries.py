"""Every registered query of the document language against its SQL in DuckDB, values and columns."""

import os

import duckdb
import pytest
from papyra import queries as Q

SF = "/root/testdata/sf0.001"  # small: the whole registry runs in one go


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def table(names, rows):
    """Rows in one order, columns by name; integral numbers of any width are the same."""
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(r[i] for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_like_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    result = duck.execute(Q.SQL[name])
    want = table([d[0] for d in result.description], result.fetchall())
    got = table(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    wrong = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    assert not wrong, wrong[0]


def test_every_query_has_sql():
    assert set(Q.QUERIES) == set(Q.SQL)

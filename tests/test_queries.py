"""Every named query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from facetflow.plans import queries as plans

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def _same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return (a is None) == (b is None) and (a is None or math.isclose(a, float(b), rel_tol=1e-9, abs_tol=1e-9))
    return a == b


@pytest.mark.parametrize("name", list(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, FOLDER)
    got = df.collect()
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    names = sorted(df.columns)
    at = [want.columns.index(c) for c in names]
    key = lambda r: tuple((x is None, str(round(x, 3)) if isinstance(x, float) else str(x)) for x in r)
    mine, other = sorted(([r[c] for c in names] for r in got), key=key), sorted(([r[i] for i in at] for r in want.fetchall()), key=key)
    assert len(mine) == len(other)
    assert all(_same(x, y) for r, s in zip(mine, other, strict=True) for x, y in zip(r, s, strict=True))

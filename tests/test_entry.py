"""Every query runs on the smallest tables; those with SQL agree with it."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from melder.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def cell(v):
    if isinstance(v, bool) or v is None:
        return v
    return round(float(v), 9) if isinstance(v, int | float | decimal.Decimal) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    want = duck.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = lambda data, cols: sorted((tuple(cell(r[cols.index(c)]) for c in sorted(cols)) for r in data), key=str)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), names)


def test_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and set(QUERIES) <= set(q)

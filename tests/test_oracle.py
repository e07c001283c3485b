"""Every query with an SQL form gives what DuckDB gives for that form."""

import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

ORACLE = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return ("s", str(v))
    return ("n", "nan" if isinstance(v, float) and math.isnan(v) else round(float(v), 6))


@pytest.mark.parametrize("name", sorted(set(ORACLE) & set(QUERIES)))
def test_matches(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    told = duck.execute(ORACLE[name])
    names = [c[0] for c in told.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(row[names.index(c)]) for c in cols) for row in told.fetchall())
    assert got == want


def test_oracles_have_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_others_have_rows(spark, name):
    """Those without an SQL form are held against loops in test_whole, test_reports and the training-data tests."""
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0

"""Every registered plan against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from leafmill.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are missing")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_plan(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    if name in catalog.ORACLES:
        r = con.execute(catalog.ORACLES[name])
        names = [x[0] for x in r.description]
        assert got == sorted(repr(tuple(x[names.index(c)] for c in cols)) for x in r.fetchall())
    else:
        assert got

"""Every registered query against its SQL, and the catalogue's shape."""

import math

import duckdb
import pytest

from loomwork import catalog
from loomwork.tables import NAMES

catalog.load_all()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x
    if isinstance(x, list):
        return [plain(v) for v in x]
    return x if x is None or isinstance(x, bool | int | str) else str(x)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in NAMES:
        con.sql(f"create view {t} as from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, duck, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    r = duck.execute(catalog.SQL[name])
    heads = [d[0] for d in r.description]
    assert sorted(heads) == cols
    want = sorted((tuple(plain(row[heads.index(c)]) for c in cols) for row in r.fetchall()), key=repr)
    got = sorted((tuple(plain(row[c]) for c in cols) for row in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs_alike_twice(spark, sf, name):
    run = lambda: sorted((tuple(plain(v) for v in r) for r in catalog.QUERIES[name](spark, sf).collect()), key=repr)
    first = run()
    assert first and first == run()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

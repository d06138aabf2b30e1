"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from corpusloom.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "hour") else v


def rows(data, names):
    order = sorted(names)
    return sorted([tuple(plain(r[names.index(c)]) for c in order) for r in data], key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    want = con.execute(registry.SQL[name])
    names = [x[0] for x in want.description]
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() >= 0

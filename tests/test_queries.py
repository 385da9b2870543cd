"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from statforge.plans import registry

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")


def canonical(frame):
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, (float, np.floating)) and v != v):
            return None
        if isinstance(v, (bool, np.bool_)):
            return bool(v)
        if isinstance(v, (int, float, np.number)):
            return round(float(v), 9)
        return v

    return list(frame.columns), sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", list(registry.SQL))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = con.execute(registry.SQL[name]).df()
    (names, a), (others, b) = canonical(got), canonical(want)
    assert names == others
    assert len(a) == len(b)
    assert a, "no rows"
    for x, y in zip(a, b, strict=True):
        assert x == y


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.SQL])
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0

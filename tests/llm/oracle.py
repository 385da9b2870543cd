"""Compare a DataFrame with DuckDB SQL over the same parquet tables or DataFrames."""

import os

import duckdb
import numpy as np
import pandas as pd


def duck(sf_dir=None, **frames):
    con = duckdb.connect()
    if sf_dir:
        for f in os.listdir(sf_dir):
            if f.endswith(".parquet"):
                con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    for name, frame in frames.items():
        con.register(name, frame.toPandas())
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, (float, np.floating)) and v != v) else round(float(v), 6) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else v
    return list(frame.columns), sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=repr)


def same_rows(got, want):
    (names, a), (others, b) = canonical(got), canonical(want)
    assert names == others
    assert len(a) == len(b), (len(a), len(b))
    for x, y in zip(a, b, strict=True):
        assert x == y

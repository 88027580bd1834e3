"""Every registered query with an oracle against DuckDB on small tables."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from skylattice import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return str(list(v))
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    return repr(float(v) + 0.0) if isinstance(v, (int, float, np.integer, np.floating)) else str(v)


def rows(df):
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_oracle(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "boxcar_snr_spatial" in e.queries()

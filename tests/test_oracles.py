"""Every query outside the training-data subpackage against DuckDB over the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tapeloom.plans.catalogue import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def cell(x):
    if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)) or str(x) == "NaT":
        return None
    if isinstance(x, (list, np.ndarray)):
        return tuple(map(cell, x))
    if isinstance(x, (bool, np.bool_)):
        return int(x)
    if isinstance(x, (int, float, np.number)):
        return float(f"{float(x):.9g}")
    return str(x)[:19].removesuffix(" 00:00:00") if hasattr(x, "year") else str(x)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    found, wanted = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert len(found) == len(wanted)
    bad = [(a, b) for a, b in zip(rows(found), rows(wanted), strict=True) if a != b]
    assert not bad, f"{len(bad)} rows differ, first {bad[0]}"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, SF).columns

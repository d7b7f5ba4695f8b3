"""Every registered query against its check SQL on the smallest tables."""
import math
import os

import duckdb
import pandas as pd
import pytest

from bundleflow.plans import projections as P
from bundleflow.plans.catalog import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in P.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 6)
    return v if isinstance(v, (int, bool)) else str(v)


def _rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(_plain, r)) for r in df.where(df.notna(), None).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, duck):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours) == _rows(theirs)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)

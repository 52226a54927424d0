"""Queries of the market-data part against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest
from conftest import SF

from tidemill.plans import registry

def rows_of(frame: pd.DataFrame) -> list:
    columns = sorted(frame.columns)

    def plain(x):
        if pd.api.types.is_scalar(x) and pd.isna(x):
            return None
        return round(float(x), 5) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted([tuple(plain(x) for x in r) for r in frame[columns].astype(object).itertuples(index=False, name=None)], key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows_of(got), rows_of(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-5 * max(1, abs(p))) for p, q in zip(x, y, strict=True)), (x, y)

"""Every registered query with an oracle equals DuckDB over the small tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from cairnfield import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = plans.oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def _value(x):
    if isinstance(x, list | np.ndarray):
        return str([_value(v) for v in x])
    if x is None or pd.isna(x):
        return "null"
    if isinstance(x, bool | np.bool_ | int | np.integer):
        return str(int(x))
    if isinstance(x, float | np.floating):
        return f"{x + 0.0:.6f}" if x != int(x) else str(int(x))
    return str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(_value(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    ours = plans.queries()[name](spark, SF).toPandas()
    theirs = duck.execute(ORACLES[name]).fetch_df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_rows_only_queries(spark):
    for name, f in plans.queries().items():
        if name not in ORACLES:
            assert f(spark, SF).count() > 0

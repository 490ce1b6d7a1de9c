"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from levelframe.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(df):
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if hasattr(v, "item"):
            return one(v.item())
        return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    names = sorted(df.columns)
    return names, sorted(tuple(one(v) for v in r) for r in df[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert plain(registry.queries()[name](spark, DATA).toPandas()) == plain(con.execute(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["detect_a1", "detect_a2", "detect_a5", "overlap_clusters", "huber_fit"])
def test_gives_rows(spark, name):
    assert registry.queries()[name](spark, DATA).count() >= 500

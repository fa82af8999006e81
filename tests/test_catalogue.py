"""Every registered query against its SQL equivalent on the small tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from strandwork.plans import catalogue

ORACLES = catalogue.oracle_sql()


def rows(df: pd.DataFrame) -> list[str]:
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
            return ""
        return f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)]
    return sorted(str([one(v) for v in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, small, name):
    got = catalogue.queries()[name](spark, small)
    if name not in ORACLES:
        assert got.count() > 0
        return
    db = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = db.execute(ORACLES[name]).df()
    got = got.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)

"""Every query against its SQL in another engine, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tessarix.plans import catalog
from tessarix.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "~"
        return str(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    ours = catalog.QUERIES[name](spark, SF).toPandas()
    theirs = duck.execute(catalog.ORACLES[name]).fetchall()
    names = [c[0] for c in duck.execute(f"describe {catalog.ORACLES[name]}").fetchall()]
    theirs = pd.DataFrame([[int(v) if hasattr(v, "as_integer_ratio") and not isinstance(v, (float, bool)) else v for v in r] for r in theirs], columns=names, dtype=object)
    assert sorted(ours.columns) == sorted(names)
    assert len(ours)
    assert rows(ours) == rows(theirs)

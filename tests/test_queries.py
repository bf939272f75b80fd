"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from kymo import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "null"
        if hasattr(v, "dtype"):
            v = v.item()
        return str(v) if isinstance(v, bool | str) else repr(round(float(v), 9)) if isinstance(v, int | float) else str(v)

    return sorted(tuple(map(one, row)) for row in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, duck, name):
    own = queries.queries()[name](spark, SF).toPandas()
    want = duck.execute(queries.oracle_sql()[name]).fetchdf()
    assert sorted(own.columns) == sorted(want.columns)
    assert canonical(own) == canonical(want)


def test_all_queries_have_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())

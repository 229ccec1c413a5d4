"""Every query with SQL must give the rows that DuckDB gives at the smallest scale; the others must run."""

import os

import duckdb
import pandas as pd
import pytest

from assayflow.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{SF}/{f}'")
    return con


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    cols = sorted(a.columns)
    for c in cols:
        if "f" in (a[c].dtype.kind, b[c].dtype.kind):
            a[c], b[c] = a[c].astype(float).round(4) + 0.0, b[c].astype(float).round(4) + 0.0
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert (a == b).all(axis=None)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    assert len(got.columns)
    if name in catalogue.oracle_sql():
        same(got, duck.sql(catalogue.oracle_sql()[name]).df())

"""Every query against its SQL in DuckDB, at the smallest size."""

import os

import duckdb
import pytest

from palimpsest import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "iufb":
            df[c] = df[c].astype("float64").round(6)
        df[c] = df[c].astype(str).replace({"None": "nan", "<NA>": "nan", "NaT": "nan", "True": "1.0", "False": "0.0"})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_agrees_with_sql(spark, duck, name):
    got, want = plain(catalog.QUERIES[name](spark, SF).toPandas()), plain(duck.sql(catalog.ORACLE[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["key", "seq", "value"]
    assert set(e.oracle_sql()) <= set(e.queries())

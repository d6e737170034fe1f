"""Every query with SQL, row by row against DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plain(v):
    if pd.isna(v):
        return None
    if isinstance(v, bool) or "bool" in type(v).__name__:
        return bool(v)
    if isinstance(v, float) or "float" in type(v).__name__:
        return round(float(v), 6)
    return int(v) if hasattr(v, "item") else v


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted((tuple(map(plain, r)) for r in frame[cols].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    got, want = rows(entry.queries()[name](spark, SF).toPandas()), rows(con.execute(entry.oracle_sql()[name]).df())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Compares a query with its SQL run by DuckDB, as sets of rows."""

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _cell(v):
    if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
        return "NULL"
    if type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    try:
        return f"{float(v):.9g}"
    except (TypeError, ValueError):
        return str(pd.Timestamp(v)) if hasattr(v, "year") else str(v)


def rows_of(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(_cell(v) for v in row) for row in pdf.itertuples(index=False))


def assert_same(df, con, sql):
    expected = con.execute(sql).df()
    got = df.toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows_of(got) == rows_of(expected)

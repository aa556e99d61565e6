"""Corpus queries with an SQL counterpart against DuckDB on the smallest tables, and the names that are registered."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from mnemograph.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(df):
    key = "lang" if "part" in df.columns else df.columns[0] if "doc_id" not in df.columns else "doc_id"
    df = df[sorted(df.columns)].sort_values([key, *(c for c in ("source", "part", "rank") if "part" in df.columns)])
    return [tuple(None if pd.isna(v) else round(v, 3) if isinstance(v, float) else v for v in r) for r in df.astype(object).itertuples(index=False, name=None)]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for x, y in zip(rows(got), rows(want), strict=True):
        assert all(a == b or (isinstance(a, float) and abs(a - b) <= 2e-3) for a, b in zip(x, y)), (x, y)


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)

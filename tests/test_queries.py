"""Every query with SQL against DuckDB on the smallest tables; every other one runs."""

import datetime
import decimal
import os

import duckdb
import pandas as pd
import pytest

from touchline.plans import catalogue
from touchline.sources.readers import TABLES


def cell(x):
    if x is None or x is pd.NaT or x is pd.NA:
        return "-"
    if isinstance(x, (float, decimal.Decimal)):
        x = float(x)
        return "-" if x != x else str(int(x)) if x == int(x) else repr(round(x, 6))
    if isinstance(x, (pd.Timestamp, datetime.date)):
        return str(pd.Timestamp(x))
    return str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(name, spark, sf, duck):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    if name in catalogue.ORACLE:
        want = duck.execute(catalogue.ORACLE[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_without_the_training_data_operators(spark):
    import __spark_entry__ as e

    assert len(e.entry(spark).collect()) == 12
    assert set(e.oracle_sql()) <= set(e.queries())

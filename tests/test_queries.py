"""Every registered query against its SQL oracle on the smallest driver tables."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as contract

FOLDER = Path("/root/testdata/sf0.001")
LARGER = Path("/root/testdata/sf0.01")  # enough events for the model fits
MODEL_QUERIES = {"cox_one_term", "ipw_one_term", "sweep_one_term", "ipw_weights", "cox_hr", "cutoff_sweep_hr"}
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="driver tables are not here")


def duck(folder):
    connection = duckdb.connect()
    for file in folder.glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, bool):
        return float(v)
    return str(v)


def table(df):
    df = df[sorted(df.columns)]
    rows = [tuple(map(cell, r)) for r in df.itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_oracle(spark, name):
    folder = LARGER if name in MODEL_QUERIES else FOLDER
    got = contract.queries()[name](spark, str(folder)).toPandas()
    expected = duck(folder).sql(contract.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert table(got) == table(expected)


def test_model_queries_run(spark):
    for name in ("ipw_weights", "cox_hr", "cutoff_sweep_hr"):
        assert contract.queries()[name](spark, str(FOLDER)).count() > 0


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() == 372

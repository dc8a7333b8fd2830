import math

import numpy as np
import pytest

from wardline.operators.describe import (
    ANALYSIS_VARS,
    ANALYSIS_VARS_WITH_SITE,
    column_summary,
    level_counts,
    missing_summary,
)
from wardline.operators.quantiles import exact_quantiles

PROBS = {"q1": 0.25, "median": 0.5, "q3": 0.75, "low": 0.0, "high": 1.0, "p99": 0.99}


@pytest.mark.parametrize(
    "values",
    [
        [1.0, 2.0, 3.0, 4.0],
        [5.0],
        [-3.5, 0.0, -0.0, 2.25, 1e-310, -1e300, 1e300, 7.0, 7.0],
        list(np.random.default_rng(1).normal(size=3001)),
        list(np.random.default_rng(2).exponential(size=500)) + [3.0] * 1000,
        list(1 + np.arange(5000) * 2.0**-40),
    ],
)
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(3)
    row = exact_quantiles(df, ["x"], PROBS).first()
    for name, q in PROBS.items():
        assert row[name] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-300), name


def test_quantiles_with_infinity_and_missing(spark):
    df = spark.createDataFrame(
        [(1.0, None), (math.inf, None), (2.0, None), (None, None), (math.nan, None)],
        "x double, y double",
    )
    (row,) = exact_quantiles(df, ["x", "y"], {"median": 0.5, "high": 1.0}).collect()
    assert (row["variable"], row["median"], row["high"]) == ("x", 2.0, math.inf)
    assert exact_quantiles(df, ["y"], {"median": 0.5}).collect() == []


def test_column_summary(spark):
    df = spark.createDataFrame(
        [(1.0, 1, None), (2.0, 2, None), (3.0, 3, None), (4.0, None, None)],
        "a double, b int, c double",
    )
    got = {r["variable"]: tuple(r)[1:] for r in column_summary(df).collect()}
    assert got["a"] == (1.0, 1.75, 2.5, 2.5, 3.25, 4.0, 0)
    assert got["b"] == (1.0, 1.5, 2.0, 2.0, 2.5, 3.0, 1)
    assert got["c"] == (None, None, None, None, None, None, 4)


def test_level_counts(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), (None, 1)], "a string, b int")
    got = {(r[0], r[1]): r[2] for r in level_counts(df, ["a", "b"]).collect()}
    assert got == {("a", "x"): 2, ("a", None): 1, ("b", "1"): 2, ("b", "2"): 1}


def test_missing_summary(spark):
    df = spark.createDataFrame([("x", 1.0), (None, math.nan), ("y", None)], "a string, b double")
    got = [tuple(r) for r in missing_summary(df).collect()]
    assert [g[:2] for g in got] == [("b", 2), ("a", 1)]
    assert got[0][2] == pytest.approx(200 / 3)


def test_analysis_variables():
    assert len(ANALYSIS_VARS) == len(set(ANALYSIS_VARS)) == 80
    assert len(ANALYSIS_VARS_WITH_SITE) == 81 and set(ANALYSIS_VARS_WITH_SITE) - set(ANALYSIS_VARS) == {"infectionsite"}


def test_missing_summary_of_all_analysis_variables(spark):
    """Every variable of both lists has its row, counted in one pass: variable k misses in the rows below k."""
    columns = [f"CASE WHEN id >= {k} THEN id * 1.0D END AS {name}" for k, name in enumerate(ANALYSIS_VARS_WITH_SITE)]
    df = spark.range(100).selectExpr(*columns)
    rows = missing_summary(df, ANALYSIS_VARS_WITH_SITE).collect()
    expected = [(name, k, float(k)) for k, name in enumerate(ANALYSIS_VARS_WITH_SITE)][::-1]
    assert [(r["variable"], r["n_miss"], r["pct_miss"]) for r in rows] == expected
    assert missing_summary(df, ANALYSIS_VARS).count() == 80

"""The study from CSV files to effects, over tables derived from the driver's events."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as contract

from wardline.operators.sweep import cutoff_sweep
from wardline.plans import derived
from wardline.plans.queries import study_model_panel
from wardline.plans.study import (
    ALBU_CUTOFFS,
    OUTCOME,
    PRESSURE_CUTOFFS,
    STUDY_MODEL,
    daily_panel,
)
from wardline.sources import SCHEMAS, load_csv_dir, write_csv

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="driver tables are not here")


def test_fixed_values(spark):
    assert all(T.StructType.fromDDL(s).fieldNames() for s in SCHEMAS.values())
    assert len(PRESSURE_CUTOFFS) == 41 and len(ALBU_CUTOFFS) == 23
    assert len(OUTCOME) == 15
    assert [len(e.numerator) for e in STUDY_MODEL.exposures] == [6, 6]
    assert [len(e.denominator) for e in STUDY_MODEL.exposures] == [12, 12]


def test_panel_from_csv_equals_panel_from_tables(spark, tmp_path):
    tables = derived.event_tables(spark, str(FOLDER))
    tables["inputs"] = tables["inputs"].withColumn("ordercategoryname", F.lit("x"))
    stays = derived.stays(spark, str(FOLDER))
    for name, table in {**tables, "cohort_stays": stays}.items():
        write_csv(table, str(tmp_path / f"{name}.csv"))
    loaded = load_csv_dir(spark, str(tmp_path), SCHEMAS, views=False)
    assert set(loaded) == {*tables, "cohort_stays"}

    def rows(panel):
        return sorted((tuple(r) for r in panel.collect()), key=str)

    direct = daily_panel(tables, stays)
    assert len(direct.columns) == 2 + 2 * 33 + 6 + 7 + 3
    a = rows(direct)
    b = rows(daily_panel(loaded, loaded["cohort_stays"]).select(direct.columns))
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, nan_ok=True)


LARGER = Path("/root/testdata/sf0.01")  # enough events for the fits
MEASURES = ["coef", "se", "hr", "inv_hr", "lo95", "hi95", "n_events"]


def test_sweep_of_one_equals_its_row_in_a_longer_sweep(spark):
    panel = study_model_panel(spark, str(LARGER), "mbp_min")
    many = cutoff_sweep(panel, STUDY_MODEL, "mbp_min", [60.0, 80.0]).effects.toPandas()
    one = cutoff_sweep(panel, STUDY_MODEL, "mbp_min", [60.0]).effects.toPandas()
    part = many[many["cutoff"] == 60.0].reset_index(drop=True)
    assert list(part["term"]) == list(one["term"]) and len(one) == 15
    assert many["converged"].all() and one["converged"].all()
    for column in MEASURES:
        assert list(part[column]) == pytest.approx(list(one[column]), rel=1e-6)


@pytest.mark.parametrize(("name", "cutoffs"), [("lactate_run", 1), ("albu_sweep", 23), ("pressure_sweep", 41)])
def test_study_runs_converge(spark, name, cutoffs):
    effects = contract.queries()[name](spark, str(LARGER)).toPandas()
    assert len(effects) == 15 * cutoffs
    assert effects["converged"].all()
    assert not effects[MEASURES].isna().any().any()
    # a weight model with few events for its terms is allowed to run out of steps, not to do so unseen
    assert set(effects["status"]) == {"converged"}
    assert all(s == "ok" or s.endswith("step limit") for s in effects["weight_status"])

"""The whole study: cohort, panel, site class and effect models."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import MAX_DAYS
from ..operators.codes import attach_flags, code_flags
from ..operators.cohort import cohort_keys, select_cohort, sepsis_cohort
from ..operators.cox import CoxResult
from ..operators.design import Category, Numeric, terms
from ..operators.features import FEATURES, FeatureSpec, daily_features
from ..operators.ipw import Exposure
from ..operators.panel import assemble_panel, counting_process, day_spine
from ..operators.sweep import EffectModel, cutoff_sweep

# Model terms.
BASELINE = terms(
    Numeric("admission_age", 10), Category("gender"), Category("admissiontype"),
    Category("ethni"), Category("infectionsite"), "first_albu",
)
TIME_VARYING = terms(
    "sofa_day", "lactate_max", Numeric("pf_min", 50), "vaso_ne", Numeric("uri_total", 1000),
    "mbp_min",
)
OUTCOME = terms(
    "albutr", "rdw_min", "bilirubin_total_max", "gcs_min", Numeric("platelet_min", 20),
    Numeric("aptt_max", 10), "mbp_min", "be_min", "bicarbonate_min", "lactate_max",
    Numeric("pao2_min", 10), Numeric("fb", 1000), "respiration_24hours", Category("gender"),
    "admission_age",
)

# Cut-offs of the sweeps.
PRESSURE_CUTOFFS = [float(c) for c in range(40, 81)]
ALBU_CUTOFFS = [
    2.0, 2.1, 2.2, 2.3, 2.4, 2.5, 2.6, 2.7, 2.8, 2.9, 3.0, 3.1, 3.2, 3.3, 3.4, 3.5, 3.6, 3.7,
    3.8, 3.9, 4.0, 4.1, 4.2,
]
LACTATE_CUTOFF = 2.1

STUDY_MODEL = EffectModel(
    id="stay_id",
    start="tstart",
    stop="tstop",
    event="event",
    exposures=(
        Exposure("treat", "albutr", BASELINE, (*BASELINE, *TIME_VARYING)),
        Exposure("cens", "dropout", BASELINE, (*BASELINE, *TIME_VARYING)),
    ),
    outcome=OUTCOME,
)


def cohort_with_flags(
    stays: DataFrame,
    sepsis: DataFrame,
    diagnoses: DataFrame,
    codebook: DataFrame | None = None,
    repaired: bool = False,
) -> DataFrame:
    """First septic stays with their infection flags: 26 + 11 columns."""
    return attach_flags(sepsis_cohort(stays, sepsis), code_flags(diagnoses, codebook, repaired=repaired))


def daily_panel(
    tables: Mapping[str, DataFrame],
    stays: DataFrame,
    specs: Iterable[FeatureSpec] = tuple(FEATURES),
    max_days: int = MAX_DAYS,
) -> DataFrame:
    """Spine of the selected cohort with all daily features whose tables are given.

    ``stays`` is the unfiltered stay table.  Status columns and covariates that are
    constant per stay are joined by the caller.
    """
    cohort = select_cohort(stays)
    daily = daily_features(dict(tables), cohort_keys(cohort), specs, max_days)
    panel = assemble_panel(day_spine(cohort, max_days), daily)
    for name in ("input_total", "output_total"):
        if name not in panel.columns:
            panel = panel.withColumn(name, F.lit(None).cast("double"))
    return counting_process(panel)


def pressure_sweep(
    panel: DataFrame,
    model: EffectModel = STUDY_MODEL,
    cutoffs: Sequence[float] = tuple(PRESSURE_CUTOFFS),
) -> CoxResult:
    """Effects among stay-days with a lowest mean pressure at or below each cut-off."""
    return cutoff_sweep(panel, model, "mbp_min", cutoffs)


def albu_sweep(
    panel: DataFrame,
    model: EffectModel = STUDY_MODEL,
    cutoffs: Sequence[float] = tuple(ALBU_CUTOFFS),
) -> CoxResult:
    """Effects among stay-days with a lowest value of that analyte at or below each cut-off."""
    return cutoff_sweep(panel, model, "albu_min", cutoffs)


def lactate_run(
    panel: DataFrame, model: EffectModel = STUDY_MODEL, cutoff: float = LACTATE_CUTOFF
) -> CoxResult:
    """Effects among stay-days with a highest lactate at or below one cut-off."""
    return cutoff_sweep(panel, model, "lactate_max", [cutoff])

"""Longitudinal cohort analytics on Spark."""

from .operators.codes import attach_flags, code_flags, site_class
from .operators.cohort import cohort_keys, select_cohort, sepsis_cohort
from .operators.cox import cox_fit
from .operators.describe import column_summary, level_counts, missing_summary
from .operators.design import Category, Numeric, centre_scale, terms
from .operators.features import FEATURES, FeatureSpec, daily_features
from .operators.ipw import Exposure, ipw_weights
from .operators.panel import assemble_panel, counting_process, day_spine
from .operators.sweep import EffectModel, cutoff_sweep, single_cutoff
from .session import durable, tune
from .sources import SCHEMAS, load_csv_dir, write_csv, write_parquet

__all__ = [
    "FEATURES",
    "SCHEMAS",
    "Category",
    "EffectModel",
    "Exposure",
    "FeatureSpec",
    "Numeric",
    "assemble_panel",
    "attach_flags",
    "centre_scale",
    "code_flags",
    "cohort_keys",
    "column_summary",
    "counting_process",
    "cox_fit",
    "cutoff_sweep",
    "daily_features",
    "day_spine",
    "durable",
    "ipw_weights",
    "level_counts",
    "load_csv_dir",
    "missing_summary",
    "select_cohort",
    "sepsis_cohort",
    "single_cutoff",
    "site_class",
    "terms",
    "tune",
    "write_csv",
    "write_parquet",
]

"""Cohort selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The cohort limits.
MIN_HOSPITAL_DAYS = 1
MIN_ICU_DAYS = 1
MAX_ICU_DAYS = 100
MIN_AGE = 18

# Columns of the cohort query, by source table.
STAY_COLUMNS = [
    "subject_id", "hadm_id", "stay_id", "gender", "dod", "hospital_expire_flag",
    "admittime", "dischtime", "los_hospital", "admission_age",
    "race", "icu_intime", "icu_outtime", "los_icu", "icustay_seq",
]
SEPSIS_COLUMNS = [
    "antibiotic_time", "culture_time", "suspected_infection_time",
    "sofa_time", "sofa_score", "respiration", "coagulation", "liver", "cardiovascular",
    "cns", "renal",
]


def select_cohort(stays: DataFrame) -> DataFrame:
    """Adult first ICU stays of at least one and at most a hundred days."""
    return (
        stays.filter(F.col("icustay_seq") == 1)
        .filter(F.col("los_hospital") >= MIN_HOSPITAL_DAYS)
        .filter(F.col("los_icu") >= MIN_ICU_DAYS)
        .filter(F.col("los_icu") <= MAX_ICU_DAYS)
        .filter(F.col("admission_age") >= MIN_AGE)
    )


def cohort_keys(cohort: DataFrame) -> DataFrame:
    """The fixed-width columns that the daily features need from the cohort."""
    return cohort.select("subject_id", "stay_id", "icu_intime")


def sepsis_cohort(stays: DataFrame, sepsis: DataFrame) -> DataFrame:
    """First stays that have a sepsis record, with the columns of both tables.

    Written as a right join; the filter on the stay side lets Catalyst run it as
    an inner join.
    """
    s, x = stays.alias("s"), sepsis.alias("x")
    return (
        s.join(x, F.col("s.stay_id") == F.col("x.stay_id"), "right")
        .filter(F.col("s.icustay_seq") == 1)
        .select(
            *[F.col(f"s.{c}") for c in STAY_COLUMNS],
            *[F.col(f"x.{c}") for c in SEPSIS_COLUMNS],
        )
    )

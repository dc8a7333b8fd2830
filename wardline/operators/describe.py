"""Summaries of columns, categories and missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import no_nan
from .quantiles import exact_quantiles, profile

# The analysis columns of the summary tables.
# fmt: off
ANALYSIS_VARS_WITH_SITE = [
    "gender", "admission_age", "weight_admit", "height", "ethni", "admissiontype", "infectionsite",
    "myocardial_infarct", "congestive_heart_failure", "peripheral_vascular_disease",
    "cerebrovascular_disease", "dementia", "chronic_pulmonary_disease", "rheumatic_disease",
    "peptic_ulcer_disease", "mild_liver_disease", "diabetes_without_cc", "diabetes_with_cc",
    "paraplegia", "renal_disease", "malignant_cancer", "severe_liver_disease",
    "metastatic_solid_tumor", "aids", "charlson_comorbidity_index", "apsiii", "oasis", "sirs",
    "sofa_score", "respiration", "coagulation", "liver", "cardiovascular", "cns", "renal",
    "wbc_max", "rdw_min", "nlr_max", "hct_min", "temp_max", "glu_max", "cl_max", "sodium_max",
    "hemoglobin_min", "alt_max", "ast_max", "albu_min", "bilirubin_total_max", "gcs_min",
    "platelet_min", "inr_max", "aptt_max", "creatinine_max", "bun_max", "heartrate_max", "sbp_min",
    "mbp_min", "dbp_min", "be_min", "bicarbonate_min", "lactate_max", "spo2_min", "pao2_min",
    "paco2_max", "pf_min", "ph_min", "resp_rate_max", "uri_total", "fb", "vaso_ne", "vaso_use",
    "rrt", "vent", "septicshock", "positive_culture", "time", "event", "hosp_mor", "los_hospital",
    "los_icu", "albu_tr",
]
# fmt: on
#: The same list as the missing-value summary takes it, without the class of the infection site.
ANALYSIS_VARS = [name for name in ANALYSIS_VARS_WITH_SITE if name != "infectionsite"]


def numeric_columns(df: DataFrame) -> list[str]:
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    return [name for name, kind in df.dtypes if kind.startswith(kinds)]


def column_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Minimum, quartiles, mean, maximum and number of missing values per column.

    All but the quartiles come out of the bucket counts that the quartiles need
    anyway, so no scan is spent on them.
    """
    known = profile(df, list(columns or numeric_columns(df)))
    present = F.col("coarse").isNotNull()
    moments = known.buckets.groupBy("variable").agg(
        F.min("low").alias("min"),
        F.try_divide(F.sum("sum"), F.sum(F.when(present, F.col("n")))).alias("mean"),
        F.max("high").alias("max"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("n_missing"),
    )
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    quartiles = exact_quantiles(df, known.columns, probs, known)
    return (
        moments.withColumn("variable", known.name())
        .join(quartiles, "variable", "left")
        .select("variable", "min", "q1", "median", "mean", "q3", "max", "n_missing")
    )


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per level of each category column; a NULL level counts missing values."""
    pairs = [
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level"))
        for c in columns
    ]
    return (
        df.select(F.explode(F.array(*pairs)).alias("e"))
        .groupBy("e.variable", "e.level")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def missing_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Number and percentage of missing values per column, most missing first."""
    columns = list(columns or df.columns)
    floating = {name for name, kind in df.dtypes if kind in ("float", "double")}
    row = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[
            F.count_if((no_nan(c) if c in floating else F.col(c)).isNull()).alias(f"{c}__n_miss")
            for c in columns
        ],
    )
    entries = [
        F.struct(F.lit(c).alias("variable"), F.col(f"{c}__n_miss").alias("n_miss"))
        for c in columns
    ]
    return (
        row.select("_rows", F.explode(F.array(*entries)).alias("e"))
        .select(
            "e.variable",
            "e.n_miss",
            F.try_divide(F.col("e.n_miss") * 100.0, F.col("_rows")).alias("pct_miss"),
        )
        .orderBy(F.desc("n_miss"), "variable")
    )

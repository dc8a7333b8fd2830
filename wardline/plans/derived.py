"""Clinical-shaped tables derived from the driver's event and order tables.

Each table exists twice, as a DataFrame and as a SQL common table expression, so
that a query over it can be compared with the same query in another engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.codebook import CATEGORIES

TYPES = ["click", "error", "purchase", "signup", "view"]

# Table and column names.
LAB_COLUMNS = {
    "complete_blood_count": ["wbc", "rdw", "hematocrit", "hemoglobin", "platelet"],
    "vital": ["temperature", "heart_rate", "sbp", "mbp", "dbp", "spo2", "resp_rate"],
    "chemistry": [
        "glucose", "chloride", "sodium", "albu", "creatinine", "bun", "bicarbonate",
    ],
    "enzyme": ["alt", "ast", "bilirubin_total"],
    "gcs": ["gcs"],
    "coagulation": ["inr", "ptt"],
    "bg": ["baseexcess", "lactate", "po2", "pco2", "pao2fio2ratio", "ph"],
}
FACTORS = {"albu": 0.08, "lactate": 0.05}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _lab_select(source: str) -> list[str]:
    if source == "blood_diff":
        return [
            "user_id AS subject_id",
            "ts AS charttime",
            "CASE WHEN event_type = 'view' THEN value END AS lymphocytes_abs",
            "CASE WHEN event_type IN ('click', 'error') THEN value END AS neutrophils",
            "CASE WHEN event_type IN ('click', 'error') THEN floor(value / 40) END AS lymphocytes",
        ]
    columns = [
        f"CASE WHEN event_type = '{TYPES[i % 5]}' "
        f"THEN value * CAST({FACTORS.get(c, 1 + i // 5)} AS DOUBLE) END AS {c}"
        for i, c in enumerate(LAB_COLUMNS[source])
    ]
    return ["user_id AS subject_id", "ts AS charttime", *columns]


_STAY = "user_id * 10 + event_id % 2 AS stay_id"

# Column lists in SQL that both engines read the same way.
EVENT_TABLES: dict[str, list[str]] = {
    **{name: _lab_select(name) for name in [*LAB_COLUMNS, "blood_diff"]},
    "urine": [
        _STAY,
        "ts AS charttime",
        "CASE WHEN event_type <> 'error' THEN value - 10 END AS urineoutput",
    ],
    "inputs": [
        _STAY,
        "ts AS starttime",
        "CASE WHEN event_id % 11 <> 0 THEN ts + INTERVAL '5' HOUR END AS endtime",
        "ts + INTERVAL '30' MINUTE AS storetime",
        "value AS amount",
        "value / 10 AS rate",
        "CASE event_type WHEN 'click' THEN 'L' WHEN 'error' THEN '' WHEN 'signup' THEN NULL "
        "ELSE 'mL' END AS amountuom",
        "CASE event_id % 3 WHEN 0 THEN 'mL/min' WHEN 1 THEN 'mL/hour' ELSE 'mcg/kg/min' END "
        "AS rateuom",
        "CASE event_id % 4 WHEN 0 THEN 'Continuous Med' WHEN 1 THEN 'Continuous IV' "
        "WHEN 2 THEN 'Drug Push' END AS ordercategorydescription",
    ],
    "outputs": [_STAY, "ts AS storetime", "value - 5 AS value"],
    "norepinephrine_equivalent_dose": [
        _STAY,
        "ts AS endtime",
        "CASE WHEN event_type = 'purchase' THEN value / 100 END AS norepinephrine_equivalent_dose",
    ],
    "rrt": [
        _STAY,
        "ts AS charttime",
        "CASE event_type WHEN 'click' THEN 'CVVH' WHEN 'view' THEN 'Peritoneal' "
        "WHEN 'error' THEN 'IHD' WHEN 'signup' THEN 'CRRT' END AS dialysis_type",
        "CAST(event_id % 2 AS INT) AS dialysis_present",
        "CAST(event_id % 3 AS INT) AS dialysis_active",
    ],
    "ventilator_setting": [_STAY, "ts AS charttime"],
    "sofa": [
        "user_id * 10 + event_id % 3 AS stay_id",
        "CAST(event_id % 800 AS INT) AS hr",
        *[
            f"CASE WHEN event_type <> '{TYPES[i % 5]}' THEN CAST(floor(value / {20 + i}) AS INT) "
            f"END AS {c}_24hours"
            for i, c in enumerate(
                ["respiration", "coagulation", "liver", "cardiovascular", "cns", "renal", "sofa"]
            )
        ],
    ],
}


def event_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One clinical-shaped table over the events."""
    return read(spark, folder, "events").selectExpr(*EVENT_TABLES[name])


def event_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All of them."""
    events = read(spark, folder, "events")
    return {name: events.selectExpr(*columns) for name, columns in EVENT_TABLES.items()}


def event_table_sql(name: str) -> str:
    return f"{name} AS (SELECT {', '.join(EVENT_TABLES[name])} FROM events)"


def stays(spark: SparkSession, folder: str) -> DataFrame:
    """Two stays per user, five days apart, so that subject joins fan out."""
    return (
        read(spark, folder, "events")
        .groupBy("user_id")
        .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        .withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
        .selectExpr(
            "user_id AS subject_id",
            "user_id AS hadm_id",
            "user_id * 10 + k AS stay_id",
            "timestampadd(DAY, 5 * k, first_ts) AS icu_intime",
            "CAST(1 + CASE WHEN user_id % 10 = 9 THEN 1 ELSE 0 END AS INT) AS icustay_seq",
            "timestampdiff(MICROSECOND, first_ts, last_ts) / 86400000000D - 5 * k AS los_icu",
            "timestampdiff(MICROSECOND, first_ts, last_ts) / 86400000000D + 1 AS los_hospital",
            "CAST(15 + user_id % 80 AS DOUBLE) AS admission_age",
        )
    )


STAYS_SQL = """
stays AS (
  SELECT user_id AS subject_id, user_id AS hadm_id, user_id * 10 + k AS stay_id,
         first_ts + INTERVAL 5 DAY * k AS icu_intime,
         1 + CASE WHEN user_id % 10 = 9 THEN 1 ELSE 0 END AS icustay_seq,
         date_diff('microsecond', first_ts, last_ts) / 86400000000::DOUBLE - 5 * k AS los_icu,
         date_diff('microsecond', first_ts, last_ts) / 86400000000::DOUBLE + 1 AS los_hospital,
         (15 + user_id % 80)::DOUBLE AS admission_age
  FROM (SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY user_id)
  CROSS JOIN (VALUES (0), (1)) AS copies(k)
),
cohort AS (
  SELECT * FROM stays
  WHERE icustay_seq = 1 AND los_hospital >= 1 AND los_icu >= 1 AND los_icu <= 100
    AND admission_age >= 18
)"""

DIAGNOSES = [
    "l_orderkey % 997 AS subject_id",
    "l_orderkey AS hadm_id",
    "CAST(9 + l_suppkey % 2 AS INT) AS icd_version",
    "CASE WHEN l_suppkey % 2 = 0 THEN lpad(CAST(l_partkey % 1000 AS VARCHAR(20)), 3, '0') "
    "ELSE concat(substr('ABGIJKLM', CAST(1 + l_orderkey % 8 AS INT), 1), "
    "lpad(CAST((l_partkey * 7) % 1000 AS VARCHAR(20)), 3, '0')) END AS icd_code",
]


def diagnoses(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "lineitem").selectExpr(*DIAGNOSES)


DIAGNOSES_SQL = f"diagnoses_icd AS (SELECT {', '.join(DIAGNOSES)} FROM lineitem)"

_CODE_9 = "lpad(CAST(p_partkey * {0} % 1000 AS VARCHAR(20)), 3, '0')"
_CODE_10 = "concat(substr('ABGIJKLM', CAST(1 + p_partkey * {0} % 8 AS INT), 1), lpad(CAST(p_partkey * {0} % 1000 AS VARCHAR(20)), 3, '0'))"
_CODES = "CASE WHEN p_partkey % 2 = 0 THEN " + _CODE_9 + " ELSE " + _CODE_10 + " END"
# Literals of a query text; in two of three, codes run together.
LITERALS = [
    "CASE CAST(p_partkey % 11 AS INT) "
    + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CATEGORIES))
    + " END AS category",
    "CAST(9 + p_partkey % 2 AS INT) AS icd_version",
    f"CASE WHEN p_partkey % 3 = 0 THEN {_CODES.format(1)} "
    f"ELSE concat({_CODES.format(1)}, '”,”', {_CODES.format(3)}, ',', {_CODES.format(7)}) END AS literal",
]


def literals(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "part").selectExpr(*LITERALS)


LITERALS_SQL = f"literals AS (SELECT {', '.join(LITERALS)} FROM part)"

# Column names.
STAY_DETAIL = [
    "o_custkey AS subject_id",
    "o_orderkey AS hadm_id",
    "o_orderkey * 10 AS stay_id",
    "CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'M' END AS gender",
    "CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate END AS dod",
    "CAST(o_orderkey % 2 AS INT) AS hospital_expire_flag",
    "o_orderdate AS admittime",
    "o_orderdate + INTERVAL '9' DAY AS dischtime",
    "CAST(9 AS DOUBLE) AS los_hospital",
    "CAST(18 + o_custkey % 70 AS DOUBLE) AS admission_age",
    "o_orderpriority AS race",
    "o_orderdate + INTERVAL '1' DAY AS icu_intime",
    "o_orderdate + INTERVAL '4' DAY AS icu_outtime",
    "CAST(3 AS DOUBLE) AS los_icu",
    "CAST(1 + o_orderkey % 3 AS INT) AS icustay_seq",
]
# Column names.
SEPSIS = [
    "o_orderkey * 5 AS stay_id",
    "o_orderdate AS antibiotic_time",
    "o_orderdate + INTERVAL '1' HOUR AS culture_time",
    "o_orderdate AS suspected_infection_time",
    "o_orderdate + INTERVAL '2' HOUR AS sofa_time",
    "CAST(o_orderkey % 20 AS INT) AS sofa_score",
    *[
        f"CAST(o_orderkey % {i + 2} AS INT) AS {c}"
        for i, c in enumerate(
            ["respiration", "coagulation", "liver", "cardiovascular", "cns", "renal"]
        )
    ],
]


def stay_detail(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").selectExpr(*STAY_DETAIL)


def sepsis(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").selectExpr(*SEPSIS)


COHORT_TABLES_SQL = (
    f"icustay_detail AS (SELECT {', '.join(STAY_DETAIL)} FROM orders), "
    f"sepsis3 AS (SELECT {', '.join(SEPSIS)} FROM orders)"
)

TableSource = Callable[[SparkSession, str], DataFrame]

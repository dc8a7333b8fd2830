"""Registered queries: each takes (spark, folder) and returns a DataFrame.

``QUERIES`` holds the Spark side and ``ORACLES`` the same result in plain SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import is_finite, meld_na, safe_ratio, strip_text, to_number
from ..operators.codebook import CATEGORIES, code_rows, codebook_frame, default_codebook, split_literals
from ..operators.codes import attach_flags, code_flags, site_class
from ..operators.cohort import cohort_keys, select_cohort, sepsis_cohort
from ..operators.cox import RowModel, cox_fit, moment_pass, prepare_panel
from ..operators.describe import ANALYSIS_VARS, column_summary, level_counts, missing_summary
from ..operators.design import Category, Numeric, centre_scale, terms
from ..operators.exposure import cumulative_product, first_exposure_rows
from ..operators.features import (
    FEATURES,
    STORED_INPUT,
    FeatureSpec,
    cohort_lookup,
    daily_scores,
    daily_source,
    grouped_specs,
)
from ..operators.intervals import infusion_volume
from ..operators.ipw import Exposure, ipw_weights
from ..operators.panel import assemble_panel, day_spine
from ..operators.sweep import EffectModel, bind_rows, cutoff_counts, cutoff_sweep, expand_cutoffs
from ..session import durable, shared_folder, tune
from ..sources import frame_sql, load_csv_dir, write_csv
from . import derived as dt
from . import model_sql as msql
from .study import albu_sweep, cohort_with_flags, daily_panel, lactate_run, pressure_sweep

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(tune(spark), folder)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


# --------------------------------------------------------------------------
# cohorts

FIRST_ORDER = "min(struct(o_orderdate, o_orderkey, o_totalprice)) AS f"


@query(
    "cohort_filter",
    """
    SELECT o_custkey, o_orderkey, o_totalprice, c_acctbal FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq
      FROM orders) o JOIN customer ON c_custkey = o_custkey
    WHERE seq = 1 AND o_totalprice >= 1 AND o_totalprice <= 200000 AND c_acctbal >= 18
    """,
)
def cohort_filter(spark, folder):
    """First order of each customer, by a map-side combined minimum instead of a ranking."""
    first = (
        dt.read(spark, folder, "orders")
        .groupBy("o_custkey")
        .agg(F.min(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("f"))
        .select("o_custkey", "f.o_orderkey", "f.o_totalprice")
    )
    customer = dt.read(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return (
        first.join(customer, first.o_custkey == customer.c_custkey)
        .filter(F.col("o_totalprice") >= 1)
        .filter(F.col("o_totalprice") <= 200000)
        .filter(F.col("c_acctbal") >= 18)
        .drop("c_custkey")
    )


@query("stay_cohort", f"WITH {dt.STAYS_SQL} SELECT * FROM cohort")
def stay_cohort(spark, folder):
    return select_cohort(dt.stays(spark, folder))


@query(
    "cohort_right_join",
    """
    SELECT c_custkey, c_acctbal, o_orderkey, o_orderstatus
    FROM orders RIGHT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'
    """,
)
def cohort_right_join(spark, folder):
    orders = dt.read(spark, folder, "orders")
    customer = dt.read(spark, folder, "customer")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey, "right")
        .filter(F.col("o_orderstatus") == "F")
        .select("c_custkey", "c_acctbal", "o_orderkey", "o_orderstatus")
    )


@query("csv_directory", "SELECT * FROM orders")
def csv_directory(spark, folder):
    """Orders written as a directory of CSV parts and loaded back by name and schema."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    orders = dt.read(spark, folder, "orders")
    write_csv(orders, f"{path}/orders.csv")
    return load_csv_dir(spark, path, {"orders": orders.schema}, views=False)["orders"]


# --------------------------------------------------------------------------
# daily features over the events, in-time = first event of the user

IN_TIME_SQL = """
intime AS (SELECT user_id, min(ts) AS t0 FROM events GROUP BY user_id),
binned AS (
  SELECT e.*, CASE WHEN us > 0 AND us <= 28 * 86400000000
                   THEN ((us + 86400000000 - 1) // 86400000000)::INT END AS day
  FROM (SELECT ev.*, date_diff('microsecond', t0, ts) AS us
        FROM events ev JOIN intime USING (user_id)) e)"""


def users_in(spark: SparkSession, folder: str) -> DataFrame:
    """Cohort of users: one stay each that starts at the first event."""
    return durable(
        dt.read(spark, folder, "events")
        .groupBy("user_id")
        .agg(F.min("ts").alias("icu_intime"))
        .select("user_id", F.col("user_id").alias("stay_id"), "icu_intime")
    )


def event_features(spark: SparkSession, folder: str, *specs: FeatureSpec) -> DataFrame:
    events = dt.read(spark, folder, "events")
    daily = daily_source(events, users_in(spark, folder), list(specs))
    return daily.withColumnRenamed("stay_id", "user_id")


def _event_spec(name, value="value", how="minmax", keep=None) -> FeatureSpec:
    return FeatureSpec(name, "events", value, "user_id", "ts", how, keep)


@query(
    "daily_minmax",
    f"""WITH {IN_TIME_SQL}
    SELECT user_id, day, min(value) AS value_min, max(value) AS value_max
    FROM binned WHERE day IS NOT NULL GROUP BY user_id, day""",
)
def daily_minmax(spark, folder):
    return event_features(spark, folder, _event_spec("value"))


@query(
    "daily_minmax_fused",
    f"WITH {IN_TIME_SQL} SELECT user_id, day, "
    + ", ".join(
        f"{a}(value) FILTER (event_type = '{t}') AS {t}_{a}" for t in dt.TYPES for a in ("min", "max")
    )
    + " FROM binned WHERE day IS NOT NULL GROUP BY user_id, day",
)
def daily_minmax_fused(spark, folder):
    specs = [_event_spec(t, f"CASE WHEN event_type = '{t}' THEN value END") for t in dt.TYPES]
    return event_features(spark, folder, *specs)


@query(
    "daily_sum_nonneg",
    f"""WITH {IN_TIME_SQL}
    SELECT user_id, day, round(sum(value - 10), 4) AS total FROM binned
    WHERE day IS NOT NULL AND value - 10 >= 0 GROUP BY user_id, day""",
)
def daily_sum_nonneg(spark, folder):
    spec = _event_spec("total", "value - 10", "sum", "value - 10 >= 0")
    return event_features(spark, folder, spec).withColumn("total", F.round("total", 4))


@query(
    "daily_max_flag",
    f"""WITH {IN_TIME_SQL}
    SELECT user_id, day, max(1.0::DOUBLE) AS flag FROM binned
    WHERE day IS NOT NULL AND event_type IN ('purchase', 'signup') GROUP BY user_id, day""",
)
def daily_max_flag(spark, folder):
    spec = _event_spec("flag", "1", "max", "event_type IN ('purchase', 'signup')")
    return event_features(spark, folder, spec)


@query(
    "daily_ratio",
    """
    WITH r AS (
      SELECT l_orderkey, CASE WHEN l_tax = 0 THEN 'inf'::DOUBLE
                              ELSE round_even(l_extendedprice / l_tax, 2) END AS ratio
      FROM lineitem)
    SELECT l_orderkey, min(ratio) AS ratio_min, max(ratio) AS ratio_max FROM r
    GROUP BY l_orderkey HAVING isfinite(max(ratio))
    """,
)
def daily_ratio(spark, folder):
    """Ratio rule without the day: one infinite ratio drops the whole group."""
    return (
        dt.read(spark, folder, "lineitem")
        .select("l_orderkey", safe_ratio("l_extendedprice", "l_tax").alias("ratio"))
        .groupBy("l_orderkey")
        .agg(F.min("ratio").alias("ratio_min"), F.max("ratio").alias("ratio_max"))
        .filter(is_finite("ratio_max"))
    )


@query(
    "hour_scores_left",
    f"""WITH {dt.event_table_sql("sofa")}, {dt.STAYS_SQL}
    SELECT s.stay_id, ceil(hr / 24.0)::INT AS day, max(sofa_24hours)::DOUBLE AS sofa_day, """
    + ", ".join(
        f"max({c}_24hours)::DOUBLE AS {c}_24hours"
        for c in ["respiration", "coagulation", "liver", "cardiovascular", "cns", "renal"]
    )
    + """ FROM sofa s LEFT JOIN cohort c ON c.stay_id = s.stay_id
    WHERE hr > 0 AND hr <= 672 GROUP BY s.stay_id, day HAVING max(sofa_24hours) IS NOT NULL""",
)
def hour_scores_left(spark, folder):
    return daily_scores(dt.event_table(spark, folder, "sofa"))


@query(
    "infusion_volume",
    """
    WITH x AS (
      SELECT l_orderkey, l_linenumber, o_orderdate AS s, l_shipdate AS e,
        CASE l_returnflag WHEN 'A' THEN l_extendedprice * 1000 ELSE l_extendedprice END AS amount,
        CASE l_returnflag WHEN 'N' THEN l_quantity * 60 ELSE l_quantity END AS rate,
        l_linestatus AS cat, l_returnflag AS unit
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT l_orderkey, round(sum(CASE WHEN cat = 'O'
        THEN rate * (date_diff('microsecond', s, e) / 3600000000::DOUBLE) ELSE amount END), 2) AS volume
    FROM x WHERE unit IN ('A', 'N') AND e > s GROUP BY l_orderkey
    """,
)
def infusion_volume_query(spark, folder):
    """Order lines as infusions: status O runs at a rate, the others count their amount."""
    lines = dt.read(spark, folder, "lineitem")
    orders = dt.read(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return (
        lines.filter(F.col("l_returnflag").isin("A", "N"))
        .join(orders, lines.l_orderkey == orders.o_orderkey)
        .filter(F.col("l_shipdate") > F.col("o_orderdate"))
        .selectExpr(
            "l_orderkey",
            "o_orderdate AS starttime",
            "l_shipdate AS endtime",
            "l_extendedprice AS amount",
            "l_quantity AS rate",
            "CASE l_returnflag WHEN 'A' THEN 'L' ELSE 'mL' END AS amountuom",
            "CASE l_returnflag WHEN 'N' THEN 'mL/min' ELSE 'mL/hour' END AS rateuom",
            "CASE l_linestatus WHEN 'O' THEN 'Continuous IV' ELSE 'Bolus' END "
            "AS ordercategorydescription",
        )
        .groupBy("l_orderkey")
        .agg(F.round(F.sum(infusion_volume()), 2).alias("volume"))
    )


@query(
    "sql_view_filter",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag IN ('A', 'N')",
)
def sql_view_filter(spark, folder):
    return frame_sql(
        "SELECT l_orderkey, l_linenumber, l_quantity FROM {t} WHERE l_returnflag IN ('A', 'N')",
        t=dt.read(spark, folder, "lineitem"),
    )


# --------------------------------------------------------------------------
# daily features of the clinical tables


def clinical_cohort(spark: SparkSession, folder: str) -> DataFrame:
    return durable(cohort_keys(select_cohort(dt.stays(spark, folder))))


def _value_sql(spec: FeatureSpec) -> str:
    if spec.name == "nlr":
        return (
            "CASE WHEN lymphocytes = 0 THEN CASE WHEN neutrophils > 0 THEN 'inf'::DOUBLE END "
            "ELSE round_even(neutrophils / lymphocytes, 2) END"
        )
    if spec.name == "input_total" and spec.time == "starttime":
        return (
            "CASE WHEN ordercategorydescription IN ('Continuous Med', 'Continuous IV') THEN "
            "CASE WHEN rateuom = 'mL/min' THEN rate * 60 ELSE rate END * "
            "(date_diff('microsecond', starttime, endtime) / 3600000000::DOUBLE) "
            "WHEN ordercategorydescription IS NOT NULL THEN "
            "CASE WHEN amountuom = 'L' THEN amount * 1000 WHEN amountuom IS NOT NULL THEN amount END "
            "END"
        )
    return spec.value


def _source_sql(specs: list[FeatureSpec]) -> str:
    """SELECT that computes one group of features, rounded sums included."""
    first = specs[0]
    keep = first.keep or "true"
    values = ", ".join(f"({_value_sql(s)})::DOUBLE AS v{i}" for i, s in enumerate(specs))
    aggregates, outputs = [], []
    for i, s in enumerate(specs):
        if s.how == "minmax":
            aggregates += [f"min(v{i}) AS lo{i}", f"max(v{i}) AS hi{i}"]
            ok = f"CASE WHEN isfinite(hi{i}) THEN"
            outputs += [f"{ok} lo{i} END AS {s.name}_min", f"{ok} hi{i} END AS {s.name}_max"]
        elif s.how == "sum":
            aggregates.append(f"round(coalesce(sum(v{i}), 0), 4) AS hi{i}")
            outputs.append(f"hi{i} AS {s.name}")
        else:
            aggregates.append(f"max(v{i}) AS hi{i}")
            outputs.append(f"hi{i} AS {s.name}")
    some = " OR ".join(f"isfinite(hi{i})" for i in range(len(specs)))
    return f"""
      SELECT stay_id, day, {', '.join(outputs)} FROM (
        SELECT stay_id, ((us + 86400000000 - 1) // 86400000000)::INT AS day, {', '.join(aggregates)}
        FROM (SELECT c.stay_id, date_diff('microsecond', icu_intime, m.{first.time}) AS us, {values}
              FROM {first.source} m JOIN cohort c ON c.{first.key} = m.{first.key} WHERE {keep})
        WHERE us > 0 AND us <= 28 * 86400000000 GROUP BY 1, 2)
      WHERE {some}"""


def _rounded(df: DataFrame, specs: list[FeatureSpec]) -> DataFrame:
    return df.withColumns({s.name: F.round(s.name, 4) for s in specs if s.how == "sum"})


def _register_source(name: str, specs: list[FeatureSpec]) -> None:
    source = specs[0].source

    @query(
        name, f"WITH {dt.STAYS_SQL}, {dt.event_table_sql(source)} {_source_sql(specs)}"
    )
    def build(spark, folder):
        table = dt.event_table(spark, folder, source)
        return _rounded(daily_source(table, clinical_cohort(spark, folder), specs), specs)


for _group in grouped_specs(FEATURES):
    _register_source(f"daily_{_group[0].source}", _group)
_register_source("daily_inputs_by_storetime", [STORED_INPUT])


@query(
    "day_spine",
    f"""WITH {dt.STAYS_SQL}
    SELECT stay_id, unnest(range(1, least(ceil(los_icu)::INT, 28) + 1))::INT AS day FROM cohort""",
)
def day_spine_query(spark, folder):
    return day_spine(select_cohort(dt.stays(spark, folder)))


PANEL_SOURCES = ["chemistry", "vital", "urine"]


def _panel_groups() -> list[list[FeatureSpec]]:
    return [g for g in grouped_specs(FEATURES) if g[0].source in PANEL_SOURCES]


PANEL_SQL = (
    f"WITH {dt.STAYS_SQL}, "
    + ", ".join(dt.event_table_sql(s) for s in PANEL_SOURCES)
    + ", "
    + ", ".join(f"f{i} AS ({_source_sql(g)})" for i, g in enumerate(_panel_groups()))
    + ", spine AS (SELECT stay_id, unnest(range(1, least(ceil(los_icu)::INT, 28) + 1))::INT AS day "
    + "FROM cohort), panel AS (SELECT * FROM spine "
    + " ".join(f"LEFT JOIN f{i} USING (stay_id, day)" for i in range(len(_panel_groups())))
    + ")"
)


def small_panel(spark: SparkSession, folder: str) -> DataFrame:
    cohort = durable(select_cohort(dt.stays(spark, folder)))
    lookup = cohort_lookup(cohort_keys(cohort))
    tables = dt.event_tables(spark, folder)
    daily = [
        _rounded(daily_source(tables[g[0].source], lookup, g), g)
        for g in _panel_groups()
    ]
    return assemble_panel(day_spine(cohort), daily)


@query("panel", f"{PANEL_SQL} SELECT * FROM panel")
def panel_query(spark, folder):
    return small_panel(spark, folder)


ALL_GROUPS = grouped_specs(FEATURES)


STUDY_SQL = (
    f"WITH {dt.STAYS_SQL}, "
    + ", ".join(dt.event_table_sql(s) for s in dt.EVENT_TABLES)
    + ", "
    + ", ".join(f"f{i} AS ({_source_sql(g)})" for i, g in enumerate(ALL_GROUPS))
    + """, scores AS (
      SELECT stay_id, ceil(hr / 24.0)::INT AS day, max(sofa_24hours)::DOUBLE AS sofa_day, """
    + ", ".join(
        f"max({c}_24hours)::DOUBLE AS {c}_24hours"
        for c in ["respiration", "coagulation", "liver", "cardiovascular", "cns", "renal"]
    )
    + """ FROM sofa WHERE hr > 0 AND hr <= 672 GROUP BY stay_id, day
      HAVING max(sofa_24hours) IS NOT NULL),
    spine AS (SELECT stay_id, unnest(range(1, least(ceil(los_icu)::INT, 28) + 1))::INT AS day
      FROM cohort),
    panel AS (SELECT *, day - 1 AS tstart, day AS tstop,
      round(coalesce(input_total, 0) - coalesce(output_total, 0), 4) AS fb FROM spine """
    + " ".join(f"LEFT JOIN f{i} USING (stay_id, day)" for i in range(len(ALL_GROUPS)))
    + " LEFT JOIN scores USING (stay_id, day))"
)


@query("study_panel", f"{STUDY_SQL} SELECT * FROM panel")
def study_panel(spark, folder):
    """All daily features of the study on the day spine."""
    stays = durable(dt.stays(spark, folder))
    panel = daily_panel(dt.event_tables(spark, folder), stays)
    sums = [s.name for s in FEATURES if s.how == "sum"]
    return panel.withColumns({c: F.round(c, 4) for c in sums}).withColumn("fb", F.round("fb", 4))


# --------------------------------------------------------------------------
# diagnosis flags

# Codes over event type (as code) and a version taken from the event number.
EVENT_CODES = [
    ("lung_infection", 9, "click"), ("lung_infection", 10, "view"),
    ("Peritoneal_infection", 9, "error"), ("Gastrointestinal_infection", 10, "purchase"),
    ("Genitourinary_infection", 9, "signup"), ("Genitourinary_infection", 10, "signup"),
]
EVENT_CATEGORIES = [
    "lung_infection", "Peritoneal_infection", "Gastrointestinal_infection",
    "Genitourinary_infection",
]
ANY_FLAGS_SQL = (
    "flags AS (SELECT user_id, "
    + ", ".join(
        "max(CASE WHEN value > 150 AND ("
        + " OR ".join(
            f"(9 + event_id % 2 = {v} AND event_type = '{code}')"
            for c, v, code in EVENT_CODES
            if c == category
        )
        + f") THEN 1 ELSE 0 END)::INT AS {category}"
        for category in EVENT_CATEGORIES
    )
    + " FROM events GROUP BY user_id)"
)


def _event_flags(spark, folder):
    rows = dt.read(spark, folder, "events").selectExpr(
        "user_id",
        "CAST(9 + event_id % 2 AS INT) AS icd_version",
        "CASE WHEN value > 150 THEN event_type ELSE 'none' END AS icd_code",
    )
    return code_flags(rows, codebook_frame(spark, EVENT_CODES), EVENT_CATEGORIES, ["user_id"])


def _as_double(df: DataFrame, columns: list[str]) -> DataFrame:
    """Flags that may be NULL, as doubles, so that both engines export them alike."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


@query("any_flags", f"WITH {ANY_FLAGS_SQL} SELECT * FROM flags")
def any_flags(spark, folder):
    return _event_flags(spark, folder)


@query(
    "flags_left_join",
    f"""WITH {ANY_FLAGS_SQL}
    SELECT c_custkey, c_mktsegment, {', '.join(f'{c}::DOUBLE AS {c}' for c in EVENT_CATEGORIES)}
    FROM customer LEFT JOIN flags ON user_id = c_custkey""",
)
def flags_left_join(spark, folder):
    customer = dt.read(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    flags = _event_flags(spark, folder).withColumnRenamed("user_id", "c_custkey")
    return _as_double(attach_flags(customer, flags, EVENT_CATEGORIES, "c_custkey"), EVENT_CATEGORIES)


@query(
    "site_class",
    f"""WITH {ANY_FLAGS_SQL}
    SELECT c_custkey, CASE WHEN lung_infection = 1 THEN 1 WHEN Peritoneal_infection = 1 THEN 2
      WHEN Gastrointestinal_infection = 1 THEN 2 WHEN Genitourinary_infection = 1 THEN 3
      ELSE 4 END::INT AS infectionsite
    FROM customer LEFT JOIN flags ON user_id = c_custkey""",
)
def site_class_query(spark, folder):
    return site_class(flags_left_join(spark, folder)).select("c_custkey", "infectionsite")


_BOOK_SQL = (
    "book(category, icd_version, icd_code) AS (VALUES "
    + ", ".join(f"('{c}', {v}, '{code}')" for c, v, code in code_rows())
    + ")"
)


def _site_sql(book: str) -> str:
    return (
        "infectionsite AS (SELECT subject_id, hadm_id, "
        + ", ".join(
            f"max(CASE WHEN category = '{c}' THEN 1 ELSE 0 END)::INT AS {c}" for c in CATEGORIES
        )
        + f" FROM diagnoses_icd LEFT JOIN {book} USING (icd_version, icd_code)"
        + " GROUP BY subject_id, hadm_id)"
    )


_FLAG_SQL = f"{dt.DIAGNOSES_SQL}, {_BOOK_SQL}, {_site_sql('book')}"
_SPLIT_SQL = f"""{dt.LITERALS_SQL}, codes AS (
    SELECT category, icd_version, icd_code, bool_or(alone) AS as_written
    FROM (SELECT category, icd_version, regexp_full_match(literal, '[0-9A-Z]+') AS alone,
            unnest(regexp_extract_all(literal, '[0-9A-Z]+')) AS icd_code FROM literals)
    GROUP BY ALL)"""


def _literal_sql(condition: str) -> str:
    return f"""WITH {dt.DIAGNOSES_SQL}, {_BOOK_SQL}, {_SPLIT_SQL},
    both_books AS (SELECT * FROM book UNION SELECT category, icd_version, icd_code FROM codes WHERE {condition}),
    {_site_sql('both_books')} SELECT * FROM infectionsite"""


@query("diagnosis_flags", f"WITH {_FLAG_SQL} SELECT * FROM infectionsite")
def diagnosis_flags(spark, folder):
    return code_flags(dt.diagnoses(spark, folder))


@query("codebook_literals", f"WITH {_SPLIT_SQL} SELECT * FROM codes")
def codebook_literals(spark, folder):
    """Codes of literals, and which of them match as written."""
    return split_literals(dt.literals(spark, folder))


@query("diagnosis_flags_literals", _literal_sql("as_written"))
def diagnosis_flags_literals(spark, folder):
    return code_flags(dt.diagnoses(spark, folder), default_codebook(spark, literals=dt.literals(spark, folder)))


@query("diagnosis_flags_repaired", _literal_sql("true"))
def diagnosis_flags_repaired(spark, folder):
    book = default_codebook(spark, literals=dt.literals(spark, folder))
    return code_flags(dt.diagnoses(spark, folder), book, repaired=True)


@query(
    "sepsis_cohort",
    f"""WITH {dt.COHORT_TABLES_SQL}
    SELECT d.*, s.* EXCLUDE (stay_id) FROM icustay_detail d
    RIGHT JOIN sepsis3 s ON d.stay_id = s.stay_id WHERE icustay_seq = 1""",
)
def sepsis_cohort_query(spark, folder):
    return sepsis_cohort(dt.stay_detail(spark, folder), dt.sepsis(spark, folder))


@query(
    "cohort_flags",
    f"""WITH {dt.COHORT_TABLES_SQL}, {_FLAG_SQL}
    SELECT d.*, s.* EXCLUDE (stay_id), {', '.join(f'f.{c}::DOUBLE AS {c}' for c in CATEGORIES)}
    FROM icustay_detail d RIGHT JOIN sepsis3 s ON d.stay_id = s.stay_id
    LEFT JOIN infectionsite f ON d.hadm_id = f.hadm_id WHERE icustay_seq = 1""",
)
def cohort_flags(spark, folder):
    joined = cohort_with_flags(
        dt.stay_detail(spark, folder), dt.sepsis(spark, folder), dt.diagnoses(spark, folder)
    )
    return _as_double(joined, CATEGORIES)


# --------------------------------------------------------------------------
# summaries

SUMMARY_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "column_summary",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, min({c}) AS min, round(quantile_cont({c}, 0.25), 4) AS q1,
        round(quantile_cont({c}, 0.5), 4) AS median, round(avg({c}), 4) AS mean,
        round(quantile_cont({c}, 0.75), 4) AS q3, max({c}) AS max,
        count(*) FILTER ({c} IS NULL) AS n_missing FROM lineitem"""
        for c in SUMMARY_COLUMNS
    ),
)
def column_summary_query(spark, folder):
    summary = column_summary(dt.read(spark, folder, "lineitem"), SUMMARY_COLUMNS)
    return summary.withColumns({c: F.round(c, 4) for c in ("q1", "median", "mean", "q3")})


LEVEL_COLUMNS = ["o_orderstatus", "o_orderpriority"]


@query(
    "level_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS variable, {c} AS level, count(*) AS n FROM orders GROUP BY {c}"
        for c in LEVEL_COLUMNS
    ),
)
def level_counts_query(spark, folder):
    return level_counts(dt.read(spark, folder, "orders"), LEVEL_COLUMNS)


_MISSING = ["glu_min", "albu_max", "sbp_min", "mbp_min", "uri_total"]


@query(
    "missing_summary",
    f"{PANEL_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count(*) FILTER ({c} IS NULL) AS n_miss, "
        f"round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 4)::DOUBLE AS pct_miss FROM panel"
        for c in _MISSING
    ),
)
def missing_summary_query(spark, folder):
    summary = missing_summary(small_panel(spark, folder), _MISSING)
    return summary.withColumn("pct_miss", F.round("pct_miss", 4))


_PANEL_VARS = [
    v for v in ANALYSIS_VARS if v == "fb" or any(v in spec.columns for spec in FEATURES)
]


@query(
    "missing_analysis_vars",
    f"{STUDY_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count(*) FILTER ({c} IS NULL) AS n_miss, "
        f"round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 4)::DOUBLE AS pct_miss FROM panel"
        for c in _PANEL_VARS
    ),
)
def missing_analysis_vars(spark, folder):
    """Missing values of the analysis variables that the daily panel holds."""
    summary = missing_summary(study_panel(spark, folder), _PANEL_VARS)
    return summary.withColumn("pct_miss", F.round("pct_miss", 4))


@query(
    "centre_scale",
    """
    SELECT l_orderkey, l_linenumber,
      round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / 10, 6) AS l_quantity,
      round((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / 1000, 4)
        AS l_extendedprice
    FROM lineitem
    """,
)
def centre_scale_query(spark, folder):
    lines = dt.read(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )
    out = centre_scale(lines, {"l_quantity": 10, "l_extendedprice": 1000})
    return out.withColumns(
        {"l_quantity": F.round("l_quantity", 6), "l_extendedprice": F.round("l_extendedprice", 4)}
    )


@query(
    "centre_scale_by_group",
    """
    SELECT l_orderkey, l_linenumber, l_returnflag,
      round((l_quantity - avg(l_quantity) OVER (PARTITION BY l_returnflag)) / 20, 6) AS l_quantity
    FROM lineitem
    """,
)
def centre_scale_by_group(spark, folder):
    lines = dt.read(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"
    )
    out = centre_scale(lines, {"l_quantity": 20}, by="l_returnflag")
    return out.withColumn("l_quantity", F.round("l_quantity", 6)).select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"
    )


@query(
    "meld_na",
    """
    SELECT l_orderkey, l_linenumber, round(10 * l_quantity + 1.32::DOUBLE * (137 - l_linenumber)
      - 0.033::DOUBLE * (10 * l_quantity) * (137 - l_linenumber), 4) AS meld FROM lineitem
    """,
)
def meld_na_query(spark, folder):
    return dt.read(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(meld_na("l_quantity", "l_linenumber"), 4).alias("meld")
    )


@query(
    "text_to_number",
    """
    SELECT event_id, try_cast(replace(replace(props, '{"k": ', ''), '}', '') AS DOUBLE) AS k,
           try_cast(event_type AS DOUBLE) AS none FROM events
    """,
)
def text_to_number(spark, folder):
    """Text to number after stripping fixed text; text that is no number gives NULL."""
    number = to_number(strip_text(strip_text("props", '{"k": '), "}"))
    return dt.read(spark, folder, "events").select(
        "event_id", number.alias("k"), to_number("event_type").alias("none")
    )


# --------------------------------------------------------------------------
# cut-offs and row binding

CUTOFFS = [2.0, 5.0, 10.0, 20.0]
_MINIMA_SQL = (
    "minima AS (SELECT user_id, ts::DATE AS d, min(value) AS vmin FROM events GROUP BY 1, 2)"
)
_MARKS_SQL = "marks(cutoff) AS (VALUES (2.0::DOUBLE), (5.0::DOUBLE), (10.0::DOUBLE), (20.0::DOUBLE))"


def _daily_minima(spark, folder):
    return (
        dt.read(spark, folder, "events")
        .groupBy("user_id", F.to_date("ts").alias("d"))
        .agg(F.min("value").alias("vmin"))
    )


@query(
    "cutoff_counts",
    f"""WITH {_MINIMA_SQL}, {_MARKS_SQL}
    SELECT cutoff, count(vmin) AS n FROM marks LEFT JOIN minima ON vmin <= cutoff GROUP BY cutoff""",
)
def cutoff_counts_query(spark, folder):
    return cutoff_counts(_daily_minima(spark, folder), "vmin", CUTOFFS)


@query(
    "cutoff_rows",
    f"""WITH {_MINIMA_SQL}, {_MARKS_SQL}
    SELECT user_id, cutoff, count(*) AS days, min(vmin) AS lowest
    FROM marks JOIN minima ON vmin <= cutoff GROUP BY user_id, cutoff""",
)
def cutoff_rows(spark, folder):
    return (
        expand_cutoffs(_daily_minima(spark, folder), "vmin", CUTOFFS)
        .groupBy("user_id", "cutoff")
        .agg(F.count(F.lit(1)).alias("days"), F.min("vmin").alias("lowest"))
    )


@query(
    "bind_rows",
    """
    SELECT 'low' AS part, o_orderkey, o_totalprice FROM orders WHERE o_totalprice <= 100000
    UNION ALL SELECT 'high', o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000
    """,
)
def bind_rows_query(spark, folder):
    orders = dt.read(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    low = orders.filter(F.col("o_totalprice") <= 100000)
    high = orders.filter(F.col("o_totalprice") > 100000)
    return bind_rows([("low", low), ("high", high)], "part")


# --------------------------------------------------------------------------
# survival panel over the events

SURVIVAL_SQL = f"""{IN_TIME_SQL},
daily AS (
  SELECT user_id, day, min(value) AS vmin, max(value) AS vmax, count(*) AS n,
         max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::INT AS exposed
  FROM binned WHERE day IS NOT NULL GROUP BY user_id, day),
marked AS (
  SELECT *, min(CASE WHEN vmax > 200 THEN day END) OVER (PARTITION BY user_id) AS event_day,
         max(day) OVER (PARTITION BY user_id) AS last_day FROM daily),
surv AS (
  SELECT user_id, day - 1 AS tstart, day AS tstop, vmin, n, exposed,
         CASE WHEN day = event_day THEN 1 ELSE 0 END AS event,
         CASE WHEN event_day IS NULL AND day = last_day AND day < 28 THEN 1 ELSE 0 END AS dropout
  FROM marked WHERE event_day IS NULL OR day <= event_day)"""


def survival_panel(spark: SparkSession, folder: str) -> DataFrame:
    """One row per user and observed day until the first day above 200."""
    daily = event_features(
        spark,
        folder,
        _event_spec("v", "value"),
        _event_spec("exposed", "CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END"),
    )
    user = Window.partitionBy("user_id")  # at most one row per day bin
    marked = daily.select(
        "*",
        F.min(F.when(F.col("v_max") > 200, F.col("day"))).over(user).alias("event_day"),
        F.max("day").over(user).alias("last_day"),
    )
    day, lives = F.col("day"), F.col("event_day").isNull()
    return marked.filter(lives | (day <= F.col("event_day"))).select(
        "user_id",
        (day - 1).alias("tstart"),
        day.alias("tstop"),
        F.col("v_min").alias("vmin"),
        F.col("exposed_max").cast("int").alias("exposed"),
        F.coalesce((day == F.col("event_day")).cast("int"), F.lit(0)).alias("event"),
        (lives & (day == F.col("last_day")) & (day < 28)).cast("int").alias("dropout"),
    )


_SURVIVAL_COLUMNS = "user_id, tstart, tstop, vmin, exposed, event, dropout"


@query("survival_panel", f"WITH {SURVIVAL_SQL} SELECT {_SURVIVAL_COLUMNS} FROM surv")
def survival_panel_query(spark, folder):
    return survival_panel(spark, folder)


@query(
    "first_exposure_rows",
    f"""WITH {SURVIVAL_SQL}
    SELECT user_id, tstop, exposed FROM (
      SELECT *, coalesce(sum(exposed) OVER (PARTITION BY user_id ORDER BY tstop
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM surv)
    WHERE seen = 0""",
)
def first_exposure_rows_query(spark, folder):
    panel = survival_panel(spark, folder).select("user_id", "tstop", "exposed")
    return first_exposure_rows(panel, "exposed", "user_id", "tstop")


@query(
    "cum_product",
    f"""WITH {SURVIVAL_SQL}
    SELECT user_id, tstop, round(product(1 - vmin / 1000) OVER (PARTITION BY user_id ORDER BY tstop
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 8) AS p FROM surv""",
)
def cum_product(spark, folder):
    p = cumulative_product(1 - F.col("vmin") / 1000, "user_id", "tstop")
    return survival_panel(spark, folder).select("user_id", "tstop", F.round(p, 8).alias("p"))


@query(
    "risk_set_sums",
    f"""WITH {SURVIVAL_SQL}, centred AS (
      SELECT *, vmin - (SELECT avg(vmin) FROM surv) AS x FROM surv)
    SELECT tstop, round(sum(exp(0.01::DOUBLE * x)), 5) AS s0,
      round(sum(x * exp(0.01::DOUBLE * x)), 3) AS s1,
      round(sum(x * x * exp(0.01::DOUBLE * x)), 1) AS s2, sum(event)::BIGINT AS events
    FROM centred GROUP BY tstop""",
)
def risk_set_sums(spark, folder):
    """Sums of one model pass at a fixed coefficient, as the fits use them."""
    panel = prepare_panel(
        survival_panel(spark, folder), "user_id", "tstart", "tstop", terms("vmin"),
        {"event": "event"},
    )
    model = RowModel("outcome", (0,), "_s_event")
    sums = moment_pass(panel, [model], [np.array([[0.01]])], [np.array([True])])
    # one covariate: four event sums, then the triangle 1, x, x * x over the risk set
    return sums.select(
        (F.col("time") + panel.first_time).alias("tstop"),
        F.round(F.col("sums")[4], 5).alias("s0"),
        F.round(F.col("sums")[5], 3).alias("s1"),
        F.round(F.col("sums")[6], 1).alias("s2"),
        F.col("sums")[0].cast("long").alias("events"),
    )


@query(
    "baseline_hazard_null",
    f"""WITH {SURVIVAL_SQL}
    SELECT tstop AS time, round(list_sum(list_transform(range(sum(event)::BIGINT),
      lambda k: 1.0::DOUBLE / (count(*) - k))), 8) AS jump
    FROM surv GROUP BY tstop HAVING sum(event) > 0""",
)
def baseline_hazard_null(spark, folder):
    """Baseline hazard of a model without terms: Nelson-Aalen jumps with Efron ties."""
    result = cox_fit(
        survival_panel(spark, folder), "user_id", "tstart", "tstop", "event", (), robust=False
    )
    return result.baseline.select("time", F.round("jump", 8).alias("jump"))


EVENT_MODEL = EffectModel(
    id="user_id",
    start="tstart",
    stop="tstop",
    event="event",
    exposures=(
        Exposure("treat", "exposed", terms(Numeric("age", 10)), terms(Numeric("age", 10), "vmin")),
        Exposure("cens", "dropout", (), terms("vmin")),
    ),
    outcome=terms("exposed", "vmin", Category("segment")),
)


def model_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Survival panel with two covariates that are constant per user."""
    return survival_panel(spark, folder).withColumns(
        {
            "age": (F.col("user_id") % 60 + 18).cast("double"),
            "segment": F.when(F.col("user_id") % 3 == 0, "a").otherwise("b"),
        }
    )


_MODEL_SQL = """
covered AS (SELECT *, (user_id % 60 + 18) / 10.0::DOUBLE AS age, CASE WHEN user_id % 3 = 0 THEN 0 ELSE 1 END AS segment FROM surv)"""
_MODEL_WEIGHTS_SQL = f"""
{msql.weights_terms("treat", "panel", "exposed", ["age"], ["age", "vmin"])},
{msql.weights_terms("cens", "panel", "dropout", [], ["vmin"])}"""
_MODEL_EFFECTS_SQL = f"""
outcome AS (
  SELECT p.cut, p.user_id AS id, p.tstop, exposed AS x1, vmin AS x2, segment AS x3, event AS s, t.w * c.w AS w
  FROM panel p
  JOIN treat_w t ON t.cut = p.cut AND t.user_id = p.user_id AND t.tstop = p.tstop
  JOIN cens_w c ON c.cut = p.cut AND c.user_id = p.user_id AND c.tstop = p.tstop),
{msql.fit_terms("m", "outcome", 3)}, {msql.effects_terms("m", "outcome", ["exposed", "vmin", "segment=b"])}"""
_MODEL_ENDS_SQL = "TRUE AS converged, 'converged' AS status, 'ok' AS weight_status"


def _rounded_numbers(effects: DataFrame) -> DataFrame:
    return effects.withColumns({c: F.round(c, 4) for c in ("coef", "se", "hr", "inv_hr", "lo95", "hi95")})


@query(
    "ipw_weights",
    f"""WITH RECURSIVE {SURVIVAL_SQL}, {_MODEL_SQL}, panel AS (SELECT 0 AS cut, * FROM covered), {_MODEL_WEIGHTS_SQL}
    SELECT t.user_id, t.tstop, round(t.w, 6) AS w_treat, round(c.w, 6) AS w_cens, round(t.w * c.w, 6) AS w
    FROM treat_w t JOIN cens_w c ON c.user_id = t.user_id AND c.tstop = t.tstop""",
)
def ipw_weights_query(spark, folder):
    weights = ipw_weights(
        model_panel(spark, folder), "user_id", "tstart", "tstop", EVENT_MODEL.exposures
    )
    return weights.withColumns({c: F.round(c, 6) for c in ("w_treat", "w_cens", "w")})


@query(
    "cox_hr",
    f"""WITH RECURSIVE {SURVIVAL_SQL}, {_MODEL_SQL}, panel AS (SELECT 0 AS cut, * FROM covered),
    {_MODEL_WEIGHTS_SQL}, {_MODEL_EFFECTS_SQL}
    SELECT NULL::DOUBLE AS cutoff, term, {_MODEL_ENDS_SQL}, {msql.effect_columns("m", 4)}""",
)
def cox_hr(spark, folder):
    return _rounded_numbers(cutoff_sweep(model_panel(spark, folder), EVENT_MODEL, None).effects)


@query(
    "cutoff_sweep_hr",
    f"""WITH RECURSIVE {SURVIVAL_SQL}, {_MODEL_SQL}, {_MARKS_SQL},
    panel AS (SELECT cutoff AS cut, covered.* FROM covered JOIN marks ON vmin <= cutoff),
    {_MODEL_WEIGHTS_SQL}, {_MODEL_EFFECTS_SQL}
    SELECT cut AS cutoff, term, {_MODEL_ENDS_SQL}, {msql.effect_columns("m", 4)}""",
)
def cutoff_sweep_hr(spark, folder):
    return _rounded_numbers(cutoff_sweep(model_panel(spark, folder), EVENT_MODEL, "vmin", CUTOFFS).effects)


# --------------------------------------------------------------------------
# models with one term, for which SQL can run the Newton steps as well

ONE_TERM_CUTOFFS = [20.0, 1000.0]
_CUT_SQL = """
panel AS (SELECT cut, surv.* FROM surv JOIN (VALUES (20.0::DOUBLE), (1000.0::DOUBLE)) c(cut)
          ON vmin <= cut)"""
ONE_TERM_EXPOSURES = (
    Exposure("treat", "exposed", (), terms("vmin")),
    Exposure("cens", "dropout", (), terms("vmin")),
)


def _rounded_effects(effects: DataFrame) -> DataFrame:
    numbers = ("coef", "se", "hr", "inv_hr", "lo95", "hi95")
    return effects.withColumns({c: F.round(c, 5) for c in numbers}).drop("converged", "term", "status", "weight_status")


@query(
    "cox_one_term",
    f"""WITH RECURSIVE {SURVIVAL_SQL},
    outcome AS (SELECT 0 AS cut, user_id AS id, tstop, vmin AS x, event AS s, 1.0::DOUBLE AS w
                FROM surv),
    {msql.fit("m", "outcome")}, {msql.effects("m", "outcome")}
    SELECT {msql.effect_columns("m")}""",
)
def cox_one_term(spark, folder):
    panel = survival_panel(spark, folder)
    fit = cox_fit(panel, "user_id", "tstart", "tstop", "event", terms("vmin"))
    return _rounded_effects(fit.effects).drop("cutoff")


@query(
    "ipw_one_term",
    f"""WITH RECURSIVE {SURVIVAL_SQL}, {_CUT_SQL},
    {msql.weights("treat", "panel", "exposed")}, {msql.weights("cens", "panel", "dropout")}
    SELECT t.user_id, t.tstop, t.cut AS cutoff, round(t.w, 6) AS w_treat, round(c.w, 6) AS w_cens,
           round(t.w * c.w, 6) AS w
    FROM treat_w t JOIN cens_w c ON c.cut = t.cut AND c.user_id = t.user_id AND c.tstop = t.tstop""",
)
def ipw_one_term(spark, folder):
    weights = ipw_weights(
        survival_panel(spark, folder), "user_id", "tstart", "tstop", ONE_TERM_EXPOSURES,
        "vmin", ONE_TERM_CUTOFFS,
    )
    return weights.withColumns({c: F.round(c, 6) for c in ("w_treat", "w_cens", "w")})


@query(
    "sweep_one_term",
    f"""WITH RECURSIVE {SURVIVAL_SQL}, {_CUT_SQL},
    {msql.weights("treat", "panel", "exposed")}, {msql.weights("cens", "panel", "dropout")},
    outcome AS (
      SELECT p.cut, p.user_id AS id, p.tstop, exposed AS x, event AS s, t.w * c.w AS w
      FROM panel p
      JOIN treat_w t ON t.cut = p.cut AND t.user_id = p.user_id AND t.tstop = p.tstop
      JOIN cens_w c ON c.cut = p.cut AND c.user_id = p.user_id AND c.tstop = p.tstop),
    {msql.fit("m", "outcome")}, {msql.effects("m", "outcome")}
    SELECT cut AS cutoff, {msql.effect_columns("m")}""",
)
def sweep_one_term(spark, folder):
    model = EffectModel(
        "user_id", "tstart", "tstop", "event", ONE_TERM_EXPOSURES, terms("exposed")
    )
    panel = survival_panel(spark, folder)
    return _rounded_effects(cutoff_sweep(panel, model, "vmin", ONE_TERM_CUTOFFS).effects)


# --------------------------------------------------------------------------
# the study models on the study panel


def _draw(*keys) -> Column:
    """A number in [0, 1) from a hash of the keys; each name gives independent numbers."""
    return F.pmod(F.xxhash64(*[k if isinstance(k, Column) else F.lit(k) for k in keys]), F.lit(1 << 32)) / float(1 << 32)


def study_model_panel(spark: SparkSession, folder: str, cut_column: str) -> DataFrame:
    """Study panel with the columns that the caller of the models supplies.

    Treatment, event, dropout and what is known of a stay are drawn from separate hashes, so that no
    covariate defines another one or the event.  The derived tables share their values among columns;
    here every measured column but that of the cut-off gets its own spread, also where it is missing.
    """
    stays = durable(dt.stays(spark, folder))
    panel = daily_panel(dt.event_tables(spark, folder), stays)
    measured = [c for c, kind in panel.dtypes if kind == "double" and c != cut_column]
    stay, day, rows = F.col("stay_id"), F.col("day"), Window.partitionBy("stay_id")  # one row per day bin
    marked = panel.select(
        "*",
        F.min(F.when(_draw(stay, day, "event") < 0.05, day)).over(rows).alias("event_day"),
        F.max("day").over(rows).alias("last_day"),
    )
    spread = {c: F.coalesce(F.col(c) * 0.1, F.lit(0.0)) + 20 + 10 * _draw(stay, day, c) for c in measured}
    ended = F.col("event_day").isNull() & (day < 28)
    return (
        marked.withColumns(spread)
        .filter(F.col("event_day").isNull() | (day <= F.col("event_day")))
        .withColumns(
            {
                "albutr": (_draw(stay, day, "treated") < 0.4).cast("int"),
                "event": F.coalesce((day == F.col("event_day")).cast("int"), F.lit(0)),
                "dropout": (ended & (day == F.col("last_day"))).cast("int"),
                "first_albu": 2 + 2 * _draw(stay, "first"),
                "admission_age": 18 + 70 * _draw(stay, "age"),
                "gender": F.when(_draw(stay, "gender") < 0.5, "F").otherwise("M"),
                "admissiontype": F.when(_draw(stay, "type") < 0.6, "urgent").otherwise("elective"),
                "ethni": F.when(_draw(stay, "ethni") < 0.4, "a").otherwise("b"),
                "infectionsite": (1 + F.floor(4 * _draw(stay, "site"))).cast("int"),
            }
        )
    )


@query("lactate_run")
def lactate_run_query(spark, folder):
    return lactate_run(study_model_panel(spark, folder, "lactate_max")).effects


@query("pressure_sweep")
def pressure_sweep_query(spark, folder):
    return pressure_sweep(study_model_panel(spark, folder, "mbp_min")).effects


@query("albu_sweep")
def albu_sweep_query(spark, folder):
    return albu_sweep(study_model_panel(spark, folder, "albu_min")).effects

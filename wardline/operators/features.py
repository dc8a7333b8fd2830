"""Daily features: one row per (stay, day) from irregular measurements.

A feature is a small declaration.  All features that read the same table with
the same key, time column and row filter are computed by one scan, one join with
the cohort and one aggregate; the cohort join is a broadcast or a split shuffle
join (see ``joins``), and the aggregate combines on the map side, so a stay with
very many measurements shuffles only its days.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime, timedelta
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType

from ..functions import (
    MAX_DAYS,
    MICROS_PER_DAY,
    day_of_micros,
    hour_bin,
    is_finite,
    micros,
    no_nan,
    safe_ratio,
)
from .intervals import VOLUME_RATE_UNITS, infusion_volume
from .joins import BROADCAST_ROWS, lookup_join

MINMAX, SUM, MAX = "minmax", "sum", "max"

# Renal replacement modes that count.
DIALYSIS_MODES = ["CVVH", "CVVHD", "CVVHDF", "SCUF", "IHD", "CRRT"]
# Organ-failure score columns of the hourly table; the first becomes sofa_day.
SCORE_COLUMNS = [
    "sofa_24hours", "respiration_24hours", "coagulation_24hours", "liver_24hours",
    "cardiovascular_24hours", "cns_24hours", "renal_24hours",
]


@dataclass(frozen=True)
class FeatureSpec:
    """One daily feature.

    ``value`` is a SQL expression over the source table, or a function that builds
    the column; ``keep`` is an optional SQL row filter.
    """

    name: str
    source: str
    value: str | Callable[[], Column]
    key: str = "subject_id"
    time: str = "charttime"
    how: str = MINMAX
    keep: str | None = None

    def expression(self) -> Column:
        if isinstance(self.value, str):
            text = f"nanvl(CAST({self.value} AS DOUBLE), CAST(NULL AS DOUBLE)) AS {self.name}"
            return F.expr(text)
        return no_nan(self.value()).alias(self.name)

    @property
    def columns(self) -> list[str]:
        if self.how == MINMAX:
            return [f"{self.name}_min", f"{self.name}_max"]
        return [self.name]

    @property
    def group(self) -> tuple:
        return (self.source, self.key, self.time, self.keep)


def one_of(column: str, values: list[str]) -> str:
    """SQL membership test."""
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def _labs(source: str, **names: str) -> list[FeatureSpec]:
    return [FeatureSpec(name, source, value) for name, value in names.items()]


def _nlr() -> Column:
    return safe_ratio("neutrophils", "lymphocytes", 2)


FEATURES: list[FeatureSpec] = [
    *_labs(
        "complete_blood_count",
        wbc="wbc", rdw="rdw", hct="hematocrit", hemoglobin="hemoglobin", platelet="platelet",
    ),
    FeatureSpec("lym", "blood_diff", "lymphocytes_abs"),
    FeatureSpec("nlr", "blood_diff", _nlr),
    *_labs(
        "vital",
        temp="temperature", heartrate="heart_rate", sbp="sbp", mbp="mbp", dbp="dbp",
        spo2="spo2", resp_rate="resp_rate",
    ),
    *_labs(
        "chemistry",
        glu="glucose", cl="chloride", sodium="sodium", albu="albu", creatinine="creatinine",
        bun="bun", bicarbonate="bicarbonate",
    ),
    *_labs("enzyme", alt="alt", ast="ast", bilirubin_total="bilirubin_total"),
    *_labs("gcs", gcs="gcs"),
    *_labs("coagulation", inr="inr", aptt="ptt"),
    *_labs(
        "bg",
        be="baseexcess", lactate="lactate", pao2="po2", paco2="pco2", pf="pao2fio2ratio", ph="ph",
    ),
    FeatureSpec(
        "uri_total", "urine", "urineoutput", "stay_id", how=SUM, keep="urineoutput >= 0"
    ),
    FeatureSpec(
        "input_total", "inputs", infusion_volume, "stay_id", "starttime", SUM,
        one_of("rateuom", VOLUME_RATE_UNITS),
    ),
    FeatureSpec(
        "output_total", "outputs", "value", "stay_id", "storetime", SUM, "value >= 0"
    ),
    FeatureSpec(
        "vaso_ne", "norepinephrine_equivalent_dose", "norepinephrine_equivalent_dose",
        "stay_id", "endtime", MAX,
    ),
    FeatureSpec(
        "rrt", "rrt", "dialysis_present", "stay_id", how=MAX,
        keep=one_of("dialysis_type", DIALYSIS_MODES),
    ),
    FeatureSpec("vent", "ventilator_setting", "1", "stay_id", how=MAX),
]

# First version of the input volume, by the time of storing; superseded by ``input_total`` above.
STORED_INPUT = FeatureSpec(
    "input_total", "inputs", "amount", "stay_id", "storetime", SUM, "amount >= 0"
)


def grouped_specs(specs: Iterable[FeatureSpec]) -> list[list[FeatureSpec]]:
    """Features that share one scan, in order of first use."""
    order: dict[tuple, int] = {}
    for spec in specs:
        order.setdefault(spec.group, len(order))
    ranked = sorted(specs, key=lambda s: order[s.group])
    return [list(g) for _, g in groupby(ranked, key=lambda s: order[s.group])]


def _aggregates(spec: FeatureSpec) -> list[str]:
    n = spec.name
    if spec.how == MINMAX:
        return [f"min({n}) AS {n}_min", f"max({n}) AS {n}_max"]
    if spec.how == SUM:
        return [f"coalesce(sum({n}), 0D) AS {n}"]
    return [f"max({n}) AS {n}"]


def _kept(spec: FeatureSpec) -> list[str]:
    """A feature is dropped from a stay-day when its last aggregate is not finite."""
    ok = f"abs({spec.columns[-1]}) < double('Infinity')"
    return [f"CASE WHEN {ok} THEN {c} END AS {c}" for c in spec.columns]


@dataclass(frozen=True)
class CohortLookup:
    """The cohort as the features join it, counted once for all of them.

    ``small`` says that the counted rows (three fixed-width columns) may be
    broadcast; ``first`` and ``last`` bound the in-times.
    """

    frame: DataFrame
    small: bool
    first: int | None  # microseconds
    last: int | None

    def window(self, time: str, max_days: int) -> Column:
        """Times that can fall into some bin; reaches the scan as a range filter."""
        low, high = (
            _time(us, self.frame.schema["icu_intime"].dataType)
            for us in (self.first, self.last + max_days * MICROS_PER_DAY)
        )
        return (F.col(time) > low) & (F.col(time) <= high)


def _time(us: int, kind: DataType) -> Column:
    """The time of that many microseconds since the epoch, the same in every session zone."""
    if isinstance(kind, TimestampNTZType):
        return F.expr(f"TIMESTAMP_NTZ '{datetime(1970, 1, 1) + timedelta(microseconds=us)}'")
    return F.timestamp_micros(F.lit(us)).cast(kind)


def cohort_lookup(cohort: DataFrame, rows: int = BROADCAST_ROWS) -> CohortLookup:
    """Count the cohort and find its range of in-times, in one job."""
    span = cohort.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(micros("icu_intime")).alias("first"),
        F.max(micros("icu_intime")).alias("last"),
    ).first()
    return CohortLookup(cohort, span["n"] <= rows, span["first"], span["last"])


def daily_source(
    table: DataFrame,
    cohort: DataFrame | CohortLookup,
    specs: list[FeatureSpec],
    max_days: int = MAX_DAYS,
) -> DataFrame:
    """All features of one source: ``(stay_id, day, ...)``, rows with some value only."""
    first = specs[0]
    if isinstance(cohort, DataFrame):
        cohort = cohort_lookup(cohort)
    facts = table.filter(first.keep) if first.keep else table
    if cohort.first is not None:
        facts = facts.filter(cohort.window(first.time, max_days))
    facts = facts.select(
        first.key, micros(first.time).alias("_time"), *[s.expression() for s in specs]
    )
    if all(s.how != SUM for s in specs):
        facts = facts.filter(f"coalesce({', '.join(s.name for s in specs)}) IS NOT NULL")
    keys = list(dict.fromkeys([first.key, "stay_id"]))
    lookup = cohort.frame.select(*keys, micros("icu_intime").alias("_from"))
    days = (
        lookup_join(facts, lookup, first.key, cohort.small)
        .withColumn("day", day_of_micros(F.col("_time") - F.col("_from"), max_days))
        .filter(F.col("day").isNotNull())
        .groupBy("stay_id", "day")
        .agg(*[F.expr(a) for s in specs for a in _aggregates(s)])
    )
    some = ", ".join(s.columns[-1] for s in specs)
    return days.selectExpr("stay_id", "day", *[c for s in specs for c in _kept(s)]).filter(
        f"coalesce({some}) IS NOT NULL"
    )


def daily_scores(scores: DataFrame, max_days: int = MAX_DAYS) -> DataFrame:
    """Daily maxima of the hourly organ-failure scores.

    The day comes from the hour column, so stays outside the cohort are kept and
    no join with the cohort is needed.  Only ``sofa_day`` decides whether a day is kept.
    """
    names = ["sofa_day", *SCORE_COLUMNS[1:]]
    return (
        scores.select(
            "stay_id",
            hour_bin("hr", max_days).alias("day"),
            *[F.expr(f"CAST({c} AS DOUBLE) AS {n}") for c, n in zip(SCORE_COLUMNS, names, strict=True)],
        )
        .filter(F.col("day").isNotNull())
        .groupBy("stay_id", "day")
        .agg(*[F.max(n).alias(n) for n in names])
        .filter(is_finite("sofa_day"))
    )


def daily_features(
    tables: dict[str, DataFrame],
    cohort: DataFrame,
    specs: Iterable[FeatureSpec] = tuple(FEATURES),
    max_days: int = MAX_DAYS,
) -> list[DataFrame]:
    """One daily table per group of features whose source is present in ``tables``."""
    lookup = cohort_lookup(cohort)
    daily = [
        daily_source(tables[group[0].source], lookup, group, max_days)
        for group in grouped_specs([s for s in specs if s.source in tables])
    ]
    if "sofa" in tables:
        daily.append(daily_scores(tables["sofa"], max_days))
    return daily

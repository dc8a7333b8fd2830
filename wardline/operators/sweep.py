"""Weighted outcome models over many nested sub-populations."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cox import CoxResult, finish, fit_models, prepare_panel, weight_shift
from .design import Term
from .ipw import Exposure, fit_weights
from .riskset import RowModel


@dataclass(frozen=True)
class EffectModel:
    """Columns and terms of a marginal structural Cox model."""

    id: str
    start: str
    stop: str
    event: str
    exposures: Sequence[Exposure]
    outcome: Sequence[Term]


def cutoff_sweep(
    panel: DataFrame, model: EffectModel, column: str | None, cutoffs: Sequence[float] = (0.0,)
) -> CoxResult:
    """Hazard ratios for the rows with ``column <= c``, for every cut-off c.

    Weights are fitted again inside every sub-population and are recomputed in the
    tasks from the small weight models, so they are never stored per cut-off.  They are kept as logarithms and divided by
    the largest one of a cut-off.  The ``report`` of the result says how every weight and outcome model ended.
    """
    exposures = list(model.exposures)
    ready = prepare_panel(
        panel, model.id, model.start, model.stop,
        [*[t for e in exposures for t in e.terms], *model.outcome],
        {"event": model.event, **{e.name: e.column for e in exposures}},
        [e.name for e in exposures], None, column, cutoffs,
    )
    outcome = RowModel("outcome", tuple(ready.design.index(model.outcome)), "_s_event")
    with ready.cached():
        weights, reports = fit_weights(ready, exposures)
        shift = weight_shift(ready, outcome, weights)
        (fits,) = fit_models(ready, [outcome], weights, shift=shift, scores=True)
        return finish(ready, outcome, fits, True, weights, shift, reports)


def single_cutoff(
    panel: DataFrame, model: EffectModel, column: str, cutoff: float
) -> CoxResult:
    """The model for one sub-population."""
    return cutoff_sweep(panel, model, column, [cutoff])


def expand_cutoffs(df: DataFrame, column: str, cutoffs: Sequence[float]) -> DataFrame:
    """Every row once per cut-off it belongs to, tagged with ``cutoff``; no join."""
    marks = F.array(*[F.lit(float(c)) for c in cutoffs])
    return df.withColumn("cutoff", F.explode(F.filter(marks, lambda c: F.col(column) <= c)))


def cutoff_counts(df: DataFrame, column: str, cutoffs: Sequence[float]) -> DataFrame:
    """Rows at or below each cut-off: one pass, one counter per cut-off."""
    row = df.agg(
        *[F.count_if(F.col(column) <= F.lit(float(c))).alias(f"n{i}") for i, c in enumerate(cutoffs)]
    )
    entries = [
        F.struct(F.lit(float(c)).alias("cutoff"), F.col(f"n{i}").alias("n"))
        for i, c in enumerate(cutoffs)
    ]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def bind_rows(frames: Iterable[tuple[object, DataFrame]], name: str) -> DataFrame:
    """Stack frames by column name, with a constant column that tells them apart."""
    tagged = [df.select(F.lit(tag).alias(name), "*") for tag, df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)

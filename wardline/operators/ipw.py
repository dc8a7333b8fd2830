"""Stabilised inverse-probability weights for a first-event exposure.

Numerator and denominator are Cox models on the rows up to and including the
first exposure (Robins, Hernan and Brumback 2000; van der Wal and Geskus 2011).
A row is unexposed with probability exp(-h), exposed with 1 - exp(-h) and has
probability 1 afterwards; weights are running products per stay.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cox import CoxFit, FitPanel, fit_models, prepare_panel, report_rows
from .design import Term
from .riskset import RowModel, WeightModels, blocks


@dataclass(frozen=True)
class Exposure:
    """One set of weights: a 0/1 column and the terms of its two models."""

    name: str
    column: str
    numerator: Sequence[Term]
    denominator: Sequence[Term]

    @property
    def terms(self) -> list[Term]:
        return [*self.numerator, *self.denominator]


def _row_models(panel: FitPanel, exposure: Exposure) -> list[RowModel]:
    status, until = f"_s_{exposure.name}", f"_until_{exposure.name}"
    return [
        RowModel(
            f"{exposure.name} {part}", tuple(panel.design.index(terms)), status, until, True
        )
        for part, terms in (
            ("numerator", exposure.numerator),
            ("denominator", exposure.denominator),
        )
    ]


def _fitted(exposure: Exposure, models, fits: list[list[CoxFit]]) -> WeightModels:
    top, bottom = models
    return WeightModels(
        name=exposure.name,
        status=top.status,
        until=top.until,
        numerator=top.index,
        denominator=bottom.index,
        numerator_beta=np.array([f.beta for f in fits[0]]),
        denominator_beta=np.array([f.beta for f in fits[1]]),
        numerator_jump=tuple(f.jumps() for f in fits[0]),
        denominator_jump=tuple(f.jumps() for f in fits[1]),
        numerator_status=tuple(f.status for f in fits[0]),
        denominator_status=tuple(f.status for f in fits[1]),
    )


def fit_weights(panel: FitPanel, exposures: Sequence[Exposure]) -> tuple[tuple[WeightModels, ...], list[tuple]]:
    """Fit the models of all exposures and cut-offs together; also rows that say how each fit ended."""
    models = [_row_models(panel, e) for e in exposures]
    flat = [m for pair in models for m in pair]
    fits = fit_models(panel, flat)
    fitted = tuple(
        _fitted(e, pair, fits[2 * i : 2 * i + 2])
        for i, (e, pair) in enumerate(zip(exposures, models, strict=True))
    )
    return fitted, [row for m, row_fits in zip(flat, fits, strict=True) for row in report_rows(panel, m.name, row_fits)]


def weight_rows(panel: FitPanel, parts: Sequence[WeightModels]) -> DataFrame:
    """``(id, time, cutoff, w_<name>...)`` for every row of every sub-population."""
    cutoffs, width, parts = panel.cutoffs, len(panel.design.labels), tuple(parts)
    first = panel.first_time

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = {}
        for block in blocks(batches, width):
            weights = [p.weights(block, cutoffs, carry) for p in parts]
            for c, cutoff in enumerate(cutoffs):
                keep = block.value <= cutoff
                yield pd.DataFrame(
                    {
                        "id": block.id[keep],
                        "time": block.stop[keep] + first,
                        "cutoff": cutoff,
                        **{f"w_{p.name}": w[keep, c] for p, w in zip(parts, weights, strict=True)},
                    }
                )

    schema = T.StructType(
        [
            T.StructField("id", panel.frame.schema["_id"].dataType),
            T.StructField("time", T.IntegerType()),
            T.StructField("cutoff", T.DoubleType()),
            *[T.StructField(f"w_{p.name}", T.DoubleType()) for p in parts],
        ]
    )
    return panel.frame.mapInPandas(rows, schema)


def ipw_weights(
    panel: DataFrame,
    id: str,
    start: str,
    stop: str,
    exposures: Sequence[Exposure],
    cut_column: str | None = None,
    cutoffs: Sequence[float] = (0.0,),
) -> DataFrame:
    """Weights per row: ``(id, stop, [cutoff,] w_<name>..., w)`` with ``w`` their product.

    Products are sums of logarithms, so factors beyond the range of numbers do no harm as long as the product is within it.
    Missing covariates in rows that a weight model uses are an error.
    """
    ready = prepare_panel(
        panel, id, start, stop, [t for e in exposures for t in e.terms],
        {e.name: e.column for e in exposures}, [e.name for e in exposures],
        None, cut_column, cutoffs,
    )
    with ready.cached():
        fitted, _ = fit_weights(ready, exposures)
    weights = weight_rows(ready, fitted)
    product = F.lit(1.0)
    for e in exposures:
        product = product * F.col(f"w_{e.name}")
    out = weights.withColumn("w", product)
    out = out.withColumnsRenamed({"id": id, "time": stop})
    return out if cut_column is not None else out.drop("cutoff")

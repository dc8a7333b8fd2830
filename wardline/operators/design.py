"""Model terms and the numeric design columns made from them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import no_nan
from .joins import is_small


@dataclass(frozen=True)
class Numeric:
    """A numeric covariate; with ``scale`` it enters as (x - mean) / scale."""

    column: str
    scale: float | None = None

    @property
    def label(self) -> str:
        return self.column if self.scale is None else f"{self.column}/{self.scale:g}"


@dataclass(frozen=True)
class Category:
    """A category as 0/1 columns, one for each level but the first.

    Without ``levels`` those of the data are taken, in order; more than ``most_levels``
    are an error, as each becomes a column of the model.
    """

    column: str
    levels: tuple | None = None
    most_levels: int = 200


Term = Numeric | Category


def terms(*items: Term | str) -> tuple[Term, ...]:
    """Terms from a mix of plain column names and term objects."""
    return tuple(Numeric(i) if isinstance(i, str) else i for i in items)


def centre_scale(
    df: DataFrame, columns: dict[str, float], by: str | None = None
) -> DataFrame:
    """Replace each column by (x - mean) / k, with the mean over all rows or per group.

    The overall means are scalar subqueries; group means come from a map-side
    combined aggregate, so neither moves the rows themselves in one task.
    """
    if by is None:
        scaled = {
            c: (F.col(c) - df.agg(F.avg(no_nan(c))).scalar()) / F.lit(float(k))
            for c, k in columns.items()
        }
        return df.withColumns(scaled)
    means = df.groupBy(by).agg(*[F.avg(no_nan(c)).alias(f"{c}__mean") for c in columns])
    if is_small(means):
        means = F.broadcast(means)
    joined = df.join(means, df[by].eqNullSafe(means[by])).drop(means[by])
    scaled = {c: (F.col(c) - F.col(f"{c}__mean")) / F.lit(float(k)) for c, k in columns.items()}
    return joined.withColumns(scaled).drop(*[f"{c}__mean" for c in columns])


@dataclass(frozen=True)
class Design:
    """Design columns of a list of terms: their labels, expressions and owners."""

    labels: tuple[str, ...]
    columns: tuple[Column, ...]
    owners: tuple[Term, ...]

    def index(self, wanted: Sequence[Term]) -> list[int]:
        """Positions of the columns that belong to ``wanted``, in that order."""
        return [i for t in wanted for i, owner in enumerate(self.owners) if owner == t]


def _levels(df: DataFrame, column: str, most: int) -> list:
    n = df.agg(F.count_distinct(column)).first()[0]
    if n > most:
        raise ValueError(f"{column} has {n} levels, more than {most}")
    return sorted(r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().collect())


def build_design(
    df: DataFrame, wanted: Sequence[Term], prefix: str = "", *aggregates: Column
) -> tuple[Design, Row]:
    """Design columns for the terms, and the row of extra ``aggregates`` of the same pass.

    All numeric columns are centred on their overall mean.  Hazard ratios do not
    depend on the centre, so one design serves every nested sub-population.
    """
    means = [
        F.avg(no_nan(prefix + t.column)).alias(f"_mean{i}")
        for i, t in enumerate(wanted)
        if isinstance(t, Numeric)
    ]
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *means, *aggregates).first()
    labels, columns, owners = [], [], []
    for i, term in enumerate(wanted):
        column = prefix + term.column
        if isinstance(term, Numeric):
            mean = row[f"_mean{i}"] or 0.0
            value = (no_nan(column) - F.lit(mean)) / F.lit(float(term.scale or 1))
            labels.append(term.label)
            columns.append(value)
            owners.append(term)
            continue
        levels = _levels(df, column, term.most_levels) if term.levels is None else list(term.levels)
        for level in levels[1:]:
            hit = F.col(column) == F.lit(level)
            labels.append(f"{term.column}={level}")
            columns.append(F.when(hit, 1.0).when(~hit, 0.0))
            owners.append(term)
    return Design(tuple(labels), tuple(columns), tuple(owners)), row

"""Weighted Cox regression on start-stop rows, as grouped sums over a Spark panel.

The panel is partitioned by stay once and kept in the checkpoint folder.  Each
Newton step is one job: every partition adds up the risk-set sums of its rows for
all models and all cut-offs, the JVM adds the partitions, and the driver
solves systems of the size of the model.  Sub-populations given by cut-offs are
nested, so the rows are never copied per cut-off.

Formulas: Cox 1972; Efron 1977 for ties; Andersen and Gill 1982 for start-stop
rows; Lin and Wei 1989 for the robust variance.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import no_nan
from ..session import durable, ship, task_count
from . import riskset, steps
from .design import Design, Term, build_design
from .exposure import exposed_from
from .riskset import (
    HELD_NUMBERS,
    RANGE,
    Jumps,
    Layout,
    Moments,
    RowModel,
    ScoreParts,
    ScoreSums,
    WeightModels,
    add_vectors,
    all_log_weights,
    all_weights,
    at_times,
    blocks,
    ranges_of,
    risk_rows,
    square,
)
from .steps import StepSums, event_rows, jump_rows, score_parts, score_rows, step_vector, stored_ranges

ship(riskset)
ship(steps)

MAX_STEPS = 30
TOLERANCE = 1e-9
ALIAS_TOLERANCE = 1e-10
Z_95 = 1.959963984540054
#: How fits end.
CONVERGED, ALL_ALIASED, NO_EVENTS = "converged", "all terms aliased", "no events"
NOT_FINITE, STEP_LIMIT, SEPARATED = "not finite", "step limit", "separated"
#: Log-likelihood per event weight from which events are told apart from all others at risk: its bound is 0.
SEPARATION = 1e-6


# --------------------------------------------------------------------------
# the prepared panel


@dataclass(frozen=True)
class FitPanel:
    """A panel ready for model passes: partitioned by stay, sorted by time, durable."""

    frame: DataFrame
    design: Design
    cutoffs: np.ndarray
    times: int
    first_time: int
    weight: str | None
    cut_column: str | None

    @contextmanager
    def cached(self) -> Iterator[FitPanel]:
        """Keep the panel on the executors for many passes; lost parts are read again."""
        self.frame.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield self
        finally:
            self.frame.unpersist()


def prepare_panel(
    panel: DataFrame,
    id: str,
    start: str,
    stop: str,
    terms: Sequence[Term],
    statuses: dict[str, str],
    exposures: Sequence[str] = (),
    weight: str | None = None,
    cut_column: str | None = None,
    cutoffs: Sequence[float] = (0.0,),
) -> FitPanel:
    """Select the model columns once, shuffle them by stay and write them.

    Design columns are cheap expressions over what was written.

    ``statuses`` maps internal names to 0/1 columns; for those also named in
    ``exposures`` the panel gets the smallest cut-off with an earlier exposure.
    """
    cutoffs = np.asarray(sorted(set(cutoffs)), dtype=float)
    terms = list(dict.fromkeys(terms))
    if cut_column is None:
        value = F.lit(0.0)
    else:
        value = no_nan(cut_column)
        panel = panel.filter(value <= F.lit(float(cutoffs[-1])))
    columns = dict.fromkeys([start, stop, *[t.column for t in terms]])
    if weight is not None:
        columns[weight] = None
    rows = panel.select(
        F.col(id).alias("_id"),
        value.alias("_value"),
        *[no_nan(column).alias(f"_s_{name}") for name, column in statuses.items()],
        *[F.col(c).alias(f"_c_{c}") for c in columns],
    ).repartition(task_count(panel.sparkSession), "_id")
    start, stop = f"_c_{start}", f"_c_{stop}"
    for name in exposures:
        seen = exposed_from(F.col(f"_s_{name}") == 1, F.col("_value"), "_id", stop)
        rows = rows.withColumn(f"_until_{name}", seen)
    rows = durable(rows.sortWithinPartitions("_id", stop))

    bad = ~(
        (F.col(start) < F.col(stop))
        & (F.col(start) == F.floor(start))
        & (F.col(stop) == F.floor(stop))
    )
    design, span = build_design(
        rows,
        terms,
        "_c_",
        F.min(start).alias("low"),
        F.max(stop).alias("high"),
        F.count_if(F.coalesce(bad, F.lit(True))).alias("bad"),
    )
    if span["bad"]:
        raise ValueError(f"{span['bad']} rows without whole start < stop times")
    low, high = int(span["low"] or 0), int(span["high"] or 0)
    frame = rows.select(
        "_id",
        (F.col(start) - low).cast("int").alias("_start"),
        (F.col(stop) - low).cast("int").alias("_stop"),
        "_value",
        *[f"_s_{name}" for name in statuses],
        *[f"_until_{name}" for name in exposures],
        *[c.alias(f"_x{i}") for i, c in enumerate(design.columns)],
        *([] if weight is None else [no_nan(f"_c_{weight}").alias("_w")]),
    )
    return FitPanel(
        frame=frame,
        design=design,
        cutoffs=cutoffs,
        times=high - low,
        first_time=low,
        weight=None if weight is None else "_w",
        cut_column=cut_column,
    )


# --------------------------------------------------------------------------
# jobs over the prepared panel


SUMS = "model int, cut int, time int, sums array<double>"
NODES = "model int, cut int, range int, node long, sums array<double>"


def _ranges(
    panel: FitPanel,
    models: Sequence[RowModel],
    betas: Sequence[np.ndarray],
    active: Sequence[np.ndarray],
    weights: tuple[WeightModels, ...],
    shift: np.ndarray | None,
) -> DataFrame:
    """Sums at the given coefficients by node of times; each (model, cut-off, range of times) is in one partition.

    Rows above all active cut-offs are left out.
    """
    cutoffs, width, own, last = panel.cutoffs, len(panel.design.labels), panel.weight, panel.times
    models, betas, active = tuple(models), tuple(betas), tuple(active)

    def handed_on(totals: Sequence[Moments]) -> Iterator[pd.DataFrame]:
        for m, total in enumerate(totals):
            for cut, nodes, vectors in total.packed():
                which, ranges = ranges_of(nodes, last)
                yield pd.DataFrame(
                    {"model": m, "cut": cut, "range": ranges, "node": nodes[which], "sums": list(vectors[which])}
                )

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals, carry = [Moments(m.layout) for m in models], {}
        for block in blocks(batches, width):
            weight = all_weights(block, weights, own, cutoffs, shift, carry)
            at_risk = risk_rows(block)
            for total, model, beta, on in zip(totals, models, betas, active, strict=True):
                if not on.any():
                    continue
                x, event, known = block.x[:, model.index], block.column(model.status) == 1, model.known(block)
                for c in np.flatnonzero(on):
                    keep = model.usable(block, known, cutoffs[c])
                    total.add(c, beta[c], x, weight[:, c], event, block.stop, at_risk, keep)
            if sum(total.held for total in totals) > HELD_NUMBERS:
                yield from handed_on(totals)
        yield from handed_on(totals)

    top = float(max(cutoffs[np.any(active, axis=0)]))
    rows = panel.frame.filter(F.col("_value") <= F.lit(top))
    return rows.mapInPandas(sums, NODES).repartition(task_count(rows.sparkSession), "model", "cut", "range")


def moment_pass(
    panel: FitPanel,
    models: Sequence[RowModel],
    betas: Sequence[np.ndarray],
    active: Sequence[np.ndarray],
    weights: tuple[WeightModels, ...] = (),
    shift: np.ndarray | None = None,
) -> DataFrame:
    """``(model, cut, time, sums)`` of every time with rows at risk, at the given coefficients.

    ``sums`` has the form of :class:`Layout`; ``time`` counts from the first one of the panel.
    """
    layouts, last = [m.layout for m in models], panel.times

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for model, cut, number, nodes, sums in stored_ranges(batches):
            time = np.arange(max(1, number << RANGE), min(last + 1, (number + 1) << RANGE))
            found = at_times(time, nodes, sums)
            keep = found[:, 3 + layouts[model].p] != 0
            if keep.any():
                yield pd.DataFrame({"model": model, "cut": cut, "time": time[keep], "sums": list(found[keep])})

    return _ranges(panel, models, betas, active, weights, shift).mapInPandas(rows, SUMS)


def step_pass(
    panel: FitPanel,
    models: Sequence[RowModel],
    betas: Sequence[np.ndarray],
    active: Sequence[np.ndarray],
    weights: tuple[WeightModels, ...] = (),
    shift: np.ndarray | None = None,
) -> dict[tuple[int, int], StepSums]:
    """What a Newton step needs, by model and cut-off; the driver gets one vector for each."""
    layouts = [m.layout for m in models]

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for model, cut, _, nodes, sums in stored_ranges(batches):
            vector = step_vector(layouts[model], event_rows(nodes, sums, layouts[model])[1])
            yield pd.DataFrame({"model": model, "cut": cut, "time": 0, "sums": [vector]})

    found = _ranges(panel, models, betas, active, weights, shift).mapInPandas(steps, SUMS)
    return {key: StepSums(layouts[key[0]], vector) for key, vector in _added(found).items()}


def time_pass(
    panel: FitPanel,
    models: Sequence[RowModel],
    betas: Sequence[np.ndarray],
    weights: tuple[WeightModels, ...] = (),
    shift: np.ndarray | None = None,
    scores: bool = False,
) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Event times and what later jobs need of them at final coefficients, by model and cut-off.

    That is the baseline jump, with ``scores`` also the parts of the score residuals: one or 2 + 3p numbers for each event
    time, which the later jobs get as a whole.
    """
    layouts, of = [m.layout for m in models], score_rows if scores else jump_rows

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for model, cut, _, nodes, sums in stored_ranges(batches):
            time, found = event_rows(nodes, sums, layouts[model])
            if len(time):
                yield pd.DataFrame({"model": model, "cut": cut, "time": time, "sums": list(of(layouts[model], found))})

    active = [np.ones(len(panel.cutoffs), bool) for _ in models]
    table = _ranges(panel, models, betas, active, weights, shift).mapInPandas(rows, SUMS).toArrow().to_pandas()
    out = {}
    for key, part in table.groupby(["model", "cut"]):
        part = part.sort_values("time")
        out[key] = part["time"].to_numpy(), np.stack(part["sums"].to_numpy())
    return out


def _added(parts: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Vectors of (model, cut, time, sums) added by model and cut-off."""
    table = parts.repartition("model", "cut").mapInPandas(add_vectors, SUMS).toArrow().to_pandas()
    return dict(zip(zip(table["model"], table["cut"], strict=True), table["sums"], strict=True))


def weight_shift(panel: FitPanel, model: RowModel, weights: tuple[WeightModels, ...]) -> np.ndarray:
    """The largest log weight of a row of the model, per cut-off.

    Weights are divided by it, so that none overflows.  Coefficients, hazard jumps and robust errors do not depend on
    the scale of the weights.
    """
    cutoffs, width = panel.cutoffs, len(panel.design.labels)

    def tops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top, carry = np.full(len(cutoffs), -np.inf), {}
        for block in blocks(batches, width):
            logs, known = all_log_weights(block, weights, cutoffs, carry), model.known(block)
            for c, cutoff in enumerate(cutoffs):
                rows = logs[model.usable(block, known, cutoff), c]
                top[c] = max(top[c], np.max(rows[np.isfinite(rows)], initial=-np.inf))
        yield pd.DataFrame({"cut": np.arange(len(cutoffs)), "top": top})

    rows = panel.frame.mapInPandas(tops, "cut int, top double").groupBy("cut").agg(F.max("top").alias("top")).collect()
    shift = np.zeros(len(cutoffs))
    for row in rows:  # one row a cut-off
        shift[row["cut"]] = row["top"] if np.isfinite(row["top"]) else 0.0
    return shift


def score_pass(
    panel: FitPanel, model: RowModel, scores: Sequence[ScoreParts], weights, shift: np.ndarray | None = None
) -> np.ndarray:
    """Sum over stays of the outer products of weighted score sums, per cut-off."""
    cutoffs, width, own = panel.cutoffs, len(panel.design.labels), panel.weight
    layout, scores = model.layout, tuple(scores)
    n, triangle = layout.p, layout.triangle

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, carry = ScoreSums(layout, len(cutoffs)), {}
        for block in blocks(batches, width):
            weight = all_weights(block, weights, own, cutoffs, shift, carry)
            x, event = block.x[:, model.index], block.column(model.status) == 1
            known = model.known(block)
            for c, score in enumerate(scores):
                rows = model.usable(block, known, cutoffs[c])
                residual = score.residuals(
                    x[rows], event[rows], block.start[rows], block.stop[rows]
                )
                total.add(c, block, rows, residual * weight[rows, c][:, None])
        cut = np.arange(len(cutoffs))
        yield pd.DataFrame({"model": 0, "cut": cut, "time": 0, "sums": list(total.finished())})

    if not n:
        return np.zeros((len(cutoffs), 0, 0))
    frame = panel.frame.filter(F.col("_value") <= F.lit(float(max(cutoffs))))
    found = _added(frame.mapInPandas(sums, SUMS))
    empty = np.zeros(len(triangle[0]))
    rows = np.array([found.get((0, c), empty) for c in range(len(cutoffs))])
    return square(rows, triangle, n)


# --------------------------------------------------------------------------
# driver-side algebra on the sums


@dataclass
class CoxFit:
    """State and result of one model at one cut-off."""

    layout: Layout
    beta: np.ndarray
    sums: StepSums | None = None  # at ``beta``
    loglik: float = -np.inf
    gradient: np.ndarray | None = None
    information: np.ndarray | None = None
    free: np.ndarray | None = None  # columns that are not aliased
    status: str = ""  # why the fit ended; empty while it runs
    steps: int = 0
    events: int = 0
    event_weight: float = 0.0
    kept: np.ndarray | None = field(default=None, repr=False)
    kept_sums: StepSums | None = field(default=None, repr=False)
    halvings: int = 0
    time: np.ndarray = field(default_factory=lambda: np.zeros(0, int), repr=False)  # event times
    at_time: np.ndarray | None = field(default=None, repr=False)  # and their numbers from ``time_pass``

    @property
    def converged(self) -> bool:
        """The coefficients that are not aliased are the maximum of the likelihood."""
        return self.status in (CONVERGED, ALL_ALIASED)

    def evaluate(self, sums: StepSums) -> float:
        """Log-likelihood, gradient and information at ``beta``; returns the former."""
        self.sums, self.events, self.event_weight = sums, sums.events, sums.event_weight
        self.gradient, self.information = sums.gradient, sums.information
        if self.free is None and np.isfinite(self.information).all():
            self.free = ~_aliased(self.information, sums.scale)
        return sums.loglik

    def advance(self, sums: StepSums) -> None:
        """Take the sums at ``beta`` and move on: accept, halve the step or stop."""
        loglik = self.evaluate(sums)
        first = self.kept is None
        finite = np.isfinite(loglik) and np.isfinite(self.gradient).all() and np.isfinite(self.information).all()
        if self.events == 0:
            self.loglik, self.status = loglik, NO_EVENTS
        elif first and not finite:
            self.loglik, self.status = loglik, NOT_FINITE
        elif not self.free.any():
            self.loglik, self.status = loglik, ALL_ALIASED if self.layout.p else CONVERGED
        elif not first and finite and abs(loglik - self.loglik) <= TOLERANCE * (abs(loglik) + self.event_weight):
            # the bound is reached only in the limit of infinite coefficients; fitted probabilities are at theirs by then
            separated = abs(loglik) <= SEPARATION * self.event_weight
            self.loglik, self.status = loglik, SEPARATED if separated else CONVERGED
        if self.status == CONVERGED and self.free.any():
            self.beta = self.beta + self._solve(self.gradient)  # one more step, which costs no pass
        if self.status:
            return
        self.steps += 1
        if not first and (not finite or loglik < self.loglik):
            self.halvings += 1
            self.beta = (self.beta + self.halvings * self.kept) / (self.halvings + 1)
            return
        self.halvings = 0
        self.loglik, self.kept, self.kept_sums = loglik, self.beta, sums
        self.beta = self.beta + self._solve(self.gradient)

    def _solve(self, vector: np.ndarray) -> np.ndarray:
        free = np.flatnonzero(self.free)
        step = np.zeros(self.layout.p)
        step[free] = np.linalg.lstsq(
            self.information[np.ix_(free, free)], vector[free], rcond=None
        )[0]
        return step

    def jumps(self) -> Jumps:
        """Baseline hazard jumps."""
        return Jumps(self.time, np.zeros(0) if self.at_time is None else self.at_time[:, 0])

    def score_parts(self) -> ScoreParts:
        rows = np.zeros((0, 2 + 3 * self.layout.p)) if self.at_time is None else self.at_time
        return score_parts(self.beta, self.time, rows)

    def variance(self, meat: np.ndarray | None) -> np.ndarray:
        """Inverse information, or the robust sandwich around ``meat``; NaN where aliased."""
        p = self.layout.p
        out = np.full((p, p), np.nan)
        free = np.flatnonzero([] if self.free is None else self.free)
        if not len(free) or self.events == 0 or not np.isfinite(self.information).all():
            return out
        bread = np.linalg.pinv(self.information[np.ix_(free, free)])
        if meat is not None:
            with np.errstate(over="ignore", invalid="ignore"):
                bread = bread @ meat[np.ix_(free, free)] @ bread
        out[np.ix_(free, free)] = bread
        return out


def _aliased(information: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Columns that add nothing to the ones before them (ordered elimination)."""
    p = len(scale)
    root = np.sqrt(np.where(scale > 0, scale, 1.0))
    a = information / np.outer(root, root)
    gone = np.zeros(p, dtype=bool)
    for i in range(p):
        if scale[i] <= 0 or not a[i, i] > ALIAS_TOLERANCE:
            gone[i] = True
            continue
        a[i + 1 :, i + 1 :] -= np.outer(a[i + 1 :, i], a[i, i + 1 :]) / a[i, i]
    return gone


def fit_models(
    panel: FitPanel,
    models: Sequence[RowModel],
    weights: tuple[WeightModels, ...] = (),
    max_steps: int = MAX_STEPS,
    shift: np.ndarray | None = None,
    scores: bool = False,
) -> list[list[CoxFit]]:
    """Fit every model at every cut-off; one job per Newton step for all of them, and one for the event times at the end.

    A fit that needs more than ``max_steps`` steps stays at its best step and has the status
    ``step limit``.  Sums that are not finite at the start end a fit as ``not finite``; later they halve the step.
    """
    fits = [
        [CoxFit(m.layout, np.zeros(len(m.index))) for _ in panel.cutoffs] for m in models
    ]
    for _ in range(max_steps + 1):
        active = [np.array([not f.status for f in row]) for row in fits]
        if not any(a.any() for a in active):
            break
        betas = [np.array([f.beta for f in row]) for row in fits]
        sums = step_pass(panel, models, betas, active, weights, shift)
        for m, row in enumerate(fits):
            nothing = StepSums(models[m].layout, np.zeros(StepSums.size(models[m].layout)))
            for c in np.flatnonzero(active[m]):
                row[c].advance(sums.get((m, c), nothing))
    for row in fits:
        for fit in row:
            if not fit.status:
                fit.status = STEP_LIMIT
                fit.beta = fit.kept
                fit.evaluate(fit.kept_sums)
    betas = [np.array([f.beta for f in row]) for row in fits]
    for (m, c), (time, rows) in time_pass(panel, models, betas, weights, shift, scores).items():
        fits[m][c].time, fits[m][c].at_time = time, rows
    return fits


# --------------------------------------------------------------------------
# results

EFFECT_SCHEMA = (
    "cutoff double, term string, coef double, se double, hr double, inv_hr double, "
    "lo95 double, hi95 double, converged boolean, n_events long, status string, weight_status string"
)


def effect_rows(
    panel: FitPanel,
    model: RowModel,
    fits: Sequence[CoxFit],
    meats: np.ndarray | None,
    troubles: Sequence[str | None] | None = None,
) -> list[tuple]:
    """Hazard-ratio rows per cut-off and term; ``status`` says how the fit ended, ``weight_status`` which weight model did not end well.

    Aliased terms have NULL numbers.  Without convergence intervals are NULL; a fit with a number that is not finite, for a
    term that is not aliased, has not converged.  Trouble in a weight model is reported and does not hide the outcome.
    """
    labels = [panel.design.labels[i] for i in model.index]
    rows = []

    def number(v: float) -> float | None:
        return float(v) if np.isfinite(v) else None

    for c, fit in enumerate(fits):
        spread = np.diag(fit.variance(None if meats is None else meats[c]))
        status, weight_status = fit.status, (troubles[c] if troubles else None) or "ok"
        free = np.zeros(len(labels), bool) if fit.free is None or not fit.events else fit.free
        beta = np.where(free, fit.beta, np.nan)
        with np.errstate(over="ignore", invalid="ignore"):
            numbers = [beta, np.sqrt(spread), np.exp(beta), np.exp(-beta)]
            numbers += [np.exp(beta - Z_95 * numbers[1]), np.exp(beta + Z_95 * numbers[1])]
        numbers = np.array(numbers)
        if status in (CONVERGED, ALL_ALIASED) and not np.isfinite(numbers[:, free]).all():
            status = NOT_FINITE
        converged = status in (CONVERGED, ALL_ALIASED)
        if not converged:
            numbers[[1, 4, 5]] = np.nan
        cutoff = None if panel.cut_column is None else float(panel.cutoffs[c])
        for j, label in enumerate(labels):
            rows.append((cutoff, label, *map(number, numbers[:, j]), converged, fit.events, status, weight_status))
    return rows


REPORT_SCHEMA = "cutoff double, model string, status string, steps int, n_events long"


def report_rows(panel: FitPanel, name: str, fits: Sequence[CoxFit]) -> list[tuple]:
    """How the fits of one model ended."""
    return [
        (None if panel.cut_column is None else float(panel.cutoffs[c]), name, fit.status, fit.steps, fit.events)
        for c, fit in enumerate(fits)
    ]


@dataclass(frozen=True)
class CoxResult:
    """A fitted model: hazard ratios, baseline hazard jumps, the raw fits and how all fits ended."""

    effects: DataFrame
    baseline: DataFrame
    fits: Sequence[CoxFit]
    panel: FitPanel
    report: DataFrame


def finish(
    panel: FitPanel,
    model: RowModel,
    fits: Sequence[CoxFit],
    robust: bool,
    weights: tuple[WeightModels, ...] = (),
    shift: np.ndarray | None = None,
    reports: Sequence[tuple] = (),
) -> CoxResult:
    """Errors, hazard ratios and the report; ``reports`` are rows about the weight models."""
    spark = panel.frame.sparkSession
    meats = None
    if robust:
        meats = score_pass(panel, model, [f.score_parts() for f in fits], weights, shift)
    rows = effect_rows(panel, model, fits, meats, [trouble_of(weights, c) for c in range(len(fits))])
    return CoxResult(
        spark.createDataFrame(rows, EFFECT_SCHEMA),
        spark.createDataFrame(_baseline(panel, fits)),
        fits,
        panel,
        spark.createDataFrame([*reports, *report_rows(panel, model.name, fits)], REPORT_SCHEMA),
    )


def _baseline(panel: FitPanel, fits: Sequence[CoxFit]) -> pa.Table:
    """``cutoff, time, jump`` of all event times with a hazard."""
    tables = []
    for c, fit in enumerate(fits):
        jumps = fit.jumps()
        some = jumps.jump > 0
        cutoff = pa.nulls(some.sum(), pa.float64()) if panel.cut_column is None else np.full(some.sum(), panel.cutoffs[c])
        tables.append(
            pa.table(
                [cutoff, jumps.time[some] + panel.first_time, jumps.jump[some]],
                pa.schema({"cutoff": pa.float64(), "time": pa.int32(), "jump": pa.float64()}),
            )
        )
    return pa.concat_tables(tables)


def trouble_of(weights: Sequence[WeightModels], cut: int) -> str | None:
    """The first weight model of a cut-off that did not end well.

    Without events all its weights are 1, and where it separates the events its probabilities, which are all that counts, have reached their limits.
    """
    for part in weights:
        for side, statuses in (("numerator", part.numerator_status), ("denominator", part.denominator_status)):
            if statuses and statuses[cut] not in (CONVERGED, ALL_ALIASED, NO_EVENTS, SEPARATED):
                return f"{part.name} {side}: {statuses[cut]}"
    return None


def cox_fit(
    panel: DataFrame,
    id: str,
    start: str,
    stop: str,
    status: str,
    terms: Sequence[Term],
    weight: str | None = None,
    robust: bool = True,
    cut_column: str | None = None,
    cutoffs: Sequence[float] = (0.0,),
    max_steps: int = MAX_STEPS,
) -> CoxResult:
    """Cox model on ``(start, stop]`` rows; rows with missing values are dropped.

    ``robust`` clusters the variance by ``id``.  With ``cut_column`` the model is
    fitted to the rows at or below each of the cut-offs.
    """
    ready = prepare_panel(
        panel, id, start, stop, terms, {"event": status}, (), weight, cut_column, cutoffs
    )
    model = RowModel("outcome", tuple(ready.design.index(terms)), "_s_event")
    with ready.cached():
        (fits,) = fit_models(ready, [model], max_steps=max_steps, scores=robust)
        return finish(ready, model, fits, robust)

"""What a Newton step needs, added over event times inside the tasks.

Everything a step reads of the sums at event times is a sum over these times, so the driver gets
one vector for each model and cut-off whatever the number of times.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

from .riskset import LEVEL, Layout, ScoreParts, Store, at_times, square

TIE_STEPS = 64


@dataclass(frozen=True)
class TieSums:
    """Sums over the Efron steps k = 0..d-1 of each event time, with f = k / d.

    With s = s0 - f t0: log s; 1 / s and f / s (a0, a1); and 1, f, f**2 over s**2
    (b0, b1, b2).
    """

    log: np.ndarray
    a0: np.ndarray
    a1: np.ndarray
    b0: np.ndarray
    b1: np.ndarray
    b2: np.ndarray


def tie_sums(s0: np.ndarray, t0: np.ndarray, d: np.ndarray) -> TieSums:
    """Sums over the steps of all times, with work that grows with the logarithm of the events of a time.

    The last ``TIE_STEPS`` steps, where s is smallest, are added one by one.  The others are sums of smooth functions
    over whole numbers: integrals (Gauss's rule over panels that double in length away from the end) with
    two terms of the Euler-Maclaurin formula at midpoints.  No difference of large numbers is formed.
    """
    out = np.zeros((6, len(d)))
    for last in range(1, min(TIE_STEPS, int(d.max(initial=0))) + 1):
        on = np.flatnonzero(d >= last)
        out[:, on] += _tie_terms(s0[on], t0[on], d[on], d[on] - last)[0]
    many = np.flatnonzero(d > TIE_STEPS)
    if len(many):
        s0, t0, d = s0[many], t0[many], np.asarray(d[many], float)
        low, high = np.full(len(d), -0.5), d - TIE_STEPS - 0.5
        for end, sign in ((high, -1.0), (low, 1.0)):
            _, first, third = _tie_terms(s0, t0, d, end)
            out[:, many] += sign * (first / 24.0 - 7.0 * third / 5760.0)
        node, weight = np.polynomial.legendre.leggauss(12)
        while len(d):
            start = np.maximum(low, d - 2.0 * (d - high))
            half = (high - start) / 2.0
            for x, w in zip(node, weight, strict=True):
                out[:, many] += w * half * _tie_terms(s0, t0, d, start + half * (1.0 + x))[0]
            go = start > low
            many, s0, t0, d, low, high = many[go], s0[go], t0[go], d[go], low[go], start[go]
    return TieSums(*out)


def _tie_terms(
    s0: np.ndarray, t0: np.ndarray, d: np.ndarray, k: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The six terms of a step k, which need not be whole, and their first and third derivatives by k."""
    f, g = k / d, 1.0 / d
    s = s0 - f * t0
    r = t0 / (d * s)  # relative change of s for a step
    zero = np.zeros_like(s)
    one, two = 1.0 / s, 1.0 / (s * s)
    # a function and its derivatives one to three
    inverse = (one, one * r, 2 * one * r**2, 6 * one * r**3)
    square = (two, 2 * two * r, 6 * two * r**2, 24 * two * r**3)
    times = lambda u: (u[0] * f, u[1] * f + u[0] * g, u[2] * f + 2 * u[1] * g, u[3] * f + 3 * u[2] * g)
    rows = ((np.log(s), -r, -(r**2) + zero, -2 * r**3), inverse, times(inverse), square, times(square), times(times(square)))
    return tuple(np.array([row[i] for row in rows]) for i in (0, 1, 3))


@dataclass(frozen=True)
class StepSums:
    """Events and their weight, log-likelihood, gradient, information and its scale at some coefficients."""

    layout: Layout
    vector: np.ndarray

    @classmethod
    def size(cls, layout: Layout) -> int:
        return 3 + 2 * layout.p + len(layout.triangle[0])

    @property
    def events(self) -> int:
        return int(np.rint(self.vector[0]))

    @property
    def event_weight(self) -> float:
        return float(self.vector[1])

    @property
    def loglik(self) -> float:
        return float(self.vector[2])

    @property
    def gradient(self) -> np.ndarray:
        return self.vector[3 : 3 + self.layout.p]

    @property
    def scale(self) -> np.ndarray:
        return self.vector[3 + self.layout.p : 3 + 2 * self.layout.p]

    @property
    def information(self) -> np.ndarray:
        return square(self.vector[None, 3 + 2 * self.layout.p :], self.layout.triangle, self.layout.p)[0]


def step_vector(layout: Layout, rows: np.ndarray) -> np.ndarray:
    """The vector of :class:`StepSums` over some event times; ``rows`` are their sums."""
    at = layout.unpack(rows)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        w, k = at.w / at.events, tie_sums(at.s0, at.t0, at.events)
        loglik = at.weta.sum() - w @ k.log
        gradient = at.wx.sum(axis=0) - (w * k.a0) @ at.s1 + (w * k.a1) @ at.t1
        cross = (at.s1 * (w * k.b1)[:, None]).T @ at.t1
        information = (
            np.tensordot(w * k.a0, at.s2, 1)
            - np.tensordot(w * k.a1, at.t2, 1)
            - (at.s1 * (w * k.b0)[:, None]).T @ at.s1
            + cross
            + cross.T
            - (at.t1 * (w * k.b2)[:, None]).T @ at.t1
        )
        scale = (w * k.a0) @ np.diagonal(at.s2, axis1=1, axis2=2)
    return np.concatenate([[at.events.sum(), at.w.sum(), loglik], gradient, scale, information[layout.triangle]])


def jump_rows(layout: Layout, rows: np.ndarray) -> np.ndarray:
    """The baseline hazard jump of each event time, as one column."""
    at = layout.unpack(rows)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        return (at.w / at.events * tie_sums(at.s0, at.t0, at.events).a0)[:, None]


def score_rows(layout: Layout, rows: np.ndarray) -> np.ndarray:
    """For each event time the jump, the hazard of an event, and the vectors ``mean``, ``v`` and ``event_v``."""
    at = layout.unpack(rows)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        w, k = at.w / at.events, tie_sums(at.s0, at.t0, at.events)

        def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return a[:, None] * at.s1 - b[:, None] * at.t1

        return np.column_stack(
            [
                w * k.a0,
                w * (k.a0 - k.a1),
                mix(k.a0, k.a1) / at.events[:, None],
                w[:, None] * mix(k.b0, k.b1),
                w[:, None] * mix(k.b0 - k.b1, k.b1 - k.b2),
            ]
        )


def score_parts(beta: np.ndarray, time: np.ndarray, rows: np.ndarray) -> ScoreParts:
    """The rows of :func:`score_rows`, read."""
    p = len(beta)
    mean, v, event_v = (rows[:, 2 + k * p : 2 + (k + 1) * p] for k in range(3))
    return ScoreParts(beta, time, mean, rows[:, 0], v, rows[:, 1], event_v)


def stored_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """Model, cut-off, range, nodes and sums of the ranges that are complete in a partition."""
    stores: dict[tuple[int, int, int], Store] = {}
    for batch in batches:
        for key, part in batch.groupby(["model", "cut", "range"], sort=False):
            store = stores.setdefault(tuple(map(int, key)), Store())
            store.add(part["node"].to_numpy(), np.stack(part["sums"].to_numpy()))
    while stores:
        key, store = stores.popitem()
        store.merge()
        yield *key, store.keys, store.sums


def event_rows(nodes: np.ndarray, sums: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Event times of a range and their sums; a time without any weight at risk is left out."""
    time = nodes[(nodes >> LEVEL == 0) & (sums[:, 0] > 0)]
    rows = at_times(time, nodes, sums)
    weighty = rows[:, 3 + layout.p] != 0
    return time[weighty], rows[weighty]

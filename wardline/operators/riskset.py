"""Arithmetic that runs inside the tasks of a model pass.

Spark partitions the panel by stay and sorts it by time; these helpers read the Arrow batches of one
partition as blocks and add up the sums of a block.  A stay may go on in the next block, so
nothing here holds more than one batch, what the last row of a stay hands on, and a bounded store of sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

#: log h below which log(1 - exp(-h)) is log h to the last bit.
SMALL_HAZARD = -37.0
#: Numbers that the sums of a task may hold before they are handed on.
HELD_NUMBERS = 8_000_000
#: Rows whose products are formed at a time.
SLICE = 16_384


@dataclass
class Block:
    """Rows sorted by stay and time; the first of them may go on with the last stay of the block before."""

    frame: pd.DataFrame
    id: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    value: np.ndarray
    x: np.ndarray
    rank: np.ndarray  # position of the row among those of its stay in the block
    continued: bool

    def column(self, name: str) -> np.ndarray:
        return self.frame[name].to_numpy(dtype=float)


def _block(frame: pd.DataFrame, width: int, before: tuple | None = None) -> Block:
    """``before`` is the stay and time of the last row of the block before."""
    id = frame["_id"].to_numpy()
    stop = frame["_stop"].to_numpy()
    new = np.ones(len(id), dtype=bool)
    new[1:] = id[1:] != id[:-1]
    continued = before is not None and id[0] == before[0]
    if (~new[1:] & (stop[1:] == stop[:-1])).any() or (continued and stop[0] == before[1]):
        raise ValueError("the panel has several rows for one stay and time")
    starts = np.flatnonzero(new)
    rank = np.arange(len(id)) - np.repeat(starts, np.diff(np.append(starts, len(id))))
    return Block(
        frame=frame,
        id=id,
        start=frame["_start"].to_numpy(),
        stop=stop,
        value=frame["_value"].to_numpy(dtype=float),
        x=frame[[f"_x{i}" for i in range(width)]].to_numpy(dtype=float),
        rank=rank,
        continued=continued,
    )


def blocks(batches: Iterator[pd.DataFrame], width: int) -> Iterator[Block]:
    """The sorted rows of a partition, batch by batch."""
    before = None
    for batch in batches:
        if len(batch):
            block = _block(batch, width, before)
            before = block.id[-1], block.stop[-1]
            yield block


@dataclass(frozen=True)
class TimeSums:
    """Sums at several event times (first axis), weighted with w * exp(eta).

    s0, s1, s2 run over the risk set and t0, t1, t2 over the events; w, weta and wx
    are the plain sums of w, w * eta and w * x over the events.
    """

    events: np.ndarray
    w: np.ndarray
    weta: np.ndarray
    wx: np.ndarray
    s0: np.ndarray
    s1: np.ndarray
    s2: np.ndarray
    t0: np.ndarray
    t1: np.ndarray
    t2: np.ndarray


@dataclass(frozen=True)
class Layout:
    """Sums of one event time as a flat vector.

    First come the event sums, then the upper triangles of the moment matrices of
    (1, x) over the risk set and over the events.
    """

    p: int

    @property
    def triangle(self) -> tuple[np.ndarray, np.ndarray]:
        """Upper triangle of a matrix of the terms."""
        return np.triu_indices(self.p)

    @property
    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        return np.triu_indices(self.p + 1)

    @property
    def size(self) -> int:
        return 3 + self.p + (self.p + 1) * (self.p + 2)

    def unpack(self, rows: np.ndarray) -> TimeSums:
        """Read vectors, one per row."""
        at = 3 + self.p
        half = (rows.shape[1] - at) // 2
        risk = square(rows[:, at : at + half], self.moments, self.p + 1)
        dead = square(rows[:, at + half :], self.moments, self.p + 1)
        return TimeSums(
            np.rint(rows[:, 0]).astype(int), rows[:, 1], rows[:, 2], rows[:, 3:at],
            risk[:, 0, 0], risk[:, 0, 1:], risk[:, 1:, 1:],
            dead[:, 0, 0], dead[:, 0, 1:], dead[:, 1:, 1:],
        )


def square(packed: np.ndarray, triangle: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Symmetric matrices from their upper triangles, one per row."""
    full = np.zeros((len(packed), n, n))
    i, j = triangle
    full[:, i, j] = packed
    full[:, j, i] = packed
    return full


def linear(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return x @ beta


def _add(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum and its rounding error."""
    with np.errstate(invalid="ignore"):
        s = a + b
        part = s - a
        error = (a - (s - part)) + (b - part)
    return s, np.where(np.isfinite(s), error, 0.0)


class Store:
    """Vectors added by whole-number keys; ``keys`` is sorted after :meth:`merge`."""

    def __init__(self) -> None:
        self.keys, self.sums = np.zeros(0, np.int64), None
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, sums: np.ndarray) -> None:
        self.new.append((keys, sums))
        self.waiting += len(keys)
        if self.waiting > max(1024, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        if not self.new:
            return
        keys, sums = zip(*self.new, strict=True)
        if self.sums is not None:
            keys, sums = (self.keys, *keys), (self.sums, *sums)
        keys, sums = np.concatenate(keys), np.concatenate(sums)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        with np.errstate(over="ignore", invalid="ignore"):
            self.keys, self.sums = keys[starts], np.add.reduceat(sums[order], starts, axis=0)
        self.new, self.waiting = [], 0


class Moments:
    """Running sums of one model for the cut-offs and nodes of times that occur in a partition."""

    def __init__(self, layout: Layout) -> None:
        self.layout = layout
        self.stores: dict[int, Store] = {}

    @property
    def held(self) -> int:
        """Numbers that are kept."""
        return self.layout.size * sum(len(s.keys) + s.waiting for s in self.stores.values())

    def add(self, cut: int, beta, x, weight, event, stop, risk: RiskRows, keep: np.ndarray) -> None:
        """Add the rows of a block that ``keep`` selects; ``risk`` has the nodes of all rows."""
        if not keep.any():
            return
        ones_x = np.column_stack([np.ones(len(x)), x])
        eta = linear(x, beta)
        with np.errstate(over="ignore", invalid="ignore"):  # a step too far is halved by the solver
            hazard = weight * np.exp(eta)
        store = self.stores.setdefault(int(cut), Store())
        at, half = 3 + self.layout.p, len(self.layout.moments[0])
        chosen = np.flatnonzero(keep[risk.row])
        for a in range(0, len(chosen), SLICE):
            rows, nodes = risk.row[chosen[a : a + SLICE]], risk.node[chosen[a : a + SLICE]]
            starts = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
            out = np.zeros((len(starts), self.layout.size))
            out[:, at : at + half] = self._products(ones_x[rows], hazard[rows], starts)
            store.add(nodes[starts], out)
        hits = np.flatnonzero(keep & event)
        hits = hits[np.argsort(stop[hits], kind="stable")]
        if not len(hits):
            return
        when, w = stop[hits].astype(np.int64), weight[hits]
        starts = np.flatnonzero(np.r_[True, when[1:] != when[:-1]])
        out = np.zeros((len(starts), self.layout.size))
        plain = np.column_stack([np.ones(len(hits)), w, w * eta[hits], w[:, None] * x[hits]])
        out[:, :at] = np.add.reduceat(plain, starts, axis=0)
        out[:, at + half :] = self._products(ones_x[hits], hazard[hits], starts)
        store.add(when[starts], out)

    def _products(self, ones_x: np.ndarray, hazard: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Upper triangles of the moment matrices of the groups that begin at ``starts``."""
        i, j = self.layout.moments
        with np.errstate(over="ignore", invalid="ignore"):
            weighted = ones_x * hazard[:, None]
            if 8 * len(starts) < len(ones_x):  # large groups: a matrix product each
                ends = np.append(starts[1:], len(ones_x))
                return np.array([(weighted[a:b].T @ ones_x[a:b])[i, j] for a, b in zip(starts, ends, strict=True)])
            return np.add.reduceat(weighted[:, i] * ones_x[:, j], starts, axis=0)

    def packed(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Cut-off, nodes and vectors of all sums; they are handed on and forgotten."""
        for cut, store in sorted(self.stores.items()):
            store.merge()
            if store.sums is not None:
                yield cut, store.keys, store.sums
        self.stores = {}


#: A node of times is level << LEVEL + place and covers the times [place << level, place + 1 << level).
LEVEL = 40
PLACE = (1 << LEVEL) - 1
#: Times of one range are 1 << RANGE; a range is what one task turns into sums at its times.
RANGE = 12


@dataclass
class RiskRows:
    """Rows of a block and the nodes that make up their time at risk, sorted by node.

    A row of one time has the node of this time; longer ones have at most two nodes for each
    doubling of their length.
    """

    row: np.ndarray
    node: np.ndarray


def risk_rows(block: Block) -> RiskRows:
    low, high = block.start.astype(np.int64) + 1, block.stop.astype(np.int64) + 1
    if (high - low == 1).all():
        rows, nodes = [np.arange(len(low))], [low]
    else:
        rows, nodes, live = [], [], np.arange(len(low))
        level = 0
        while len(live):
            odd = live[low[live] & 1 == 1]
            rows.append(odd)
            nodes.append(level << LEVEL | low[odd])
            low[odd] += 1
            odd = live[(high[live] & 1 == 1) & (low[live] < high[live])]
            high[odd] -= 1
            rows.append(odd)
            nodes.append(level << LEVEL | high[odd])
            low >>= 1
            high >>= 1
            live, level = live[low[live] < high[live]], level + 1
    row, node = np.concatenate(rows), np.concatenate(nodes)
    order = np.argsort(node, kind="stable")
    return RiskRows(row[order], node[order])


def ranges_of(nodes: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of nodes and the ranges they meet; a node above a range is in each of those it covers."""
    level, place = nodes >> LEVEL, nodes & PLACE
    up, down = np.maximum(level - RANGE, 0), np.maximum(RANGE - level, 0)
    first = np.where(level > RANGE, place << up, place >> down)
    end = np.where(level > RANGE, np.minimum((place + 1) << up, (last >> RANGE) + 1), first + 1)
    count = end - first
    which = np.repeat(np.arange(len(nodes)), count)
    return which, first[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)


def at_times(time: np.ndarray, nodes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Vectors at times: those of all nodes that cover a time, added; no difference is formed.  ``nodes`` is sorted."""
    out = np.zeros((len(time), sums.shape[1]))
    level = nodes >> LEVEL
    for step in np.unique(level):
        here = np.flatnonzero(level == step)
        want = step << LEVEL | time >> step
        at = np.searchsorted(nodes[here], want)
        found = np.flatnonzero(at < len(here))
        found = found[nodes[here[at[found]]] == want[found]]
        out[found] += sums[here[at[found]]]
    return out


@dataclass(frozen=True)
class RowModel:
    """Which rows a model uses and which columns it reads.

    A row belongs to cut-off c when ``value <= c`` and, with ``until``, when c is
    below that column.
    """

    name: str
    index: tuple[int, ...]
    status: str
    until: str | None = None
    complete: bool = False  # missing covariates are an error instead of dropped

    @property
    def layout(self) -> Layout:
        return Layout(len(self.index))

    def known(self, block: Block) -> np.ndarray:
        """Rows without missing values in the columns of the model."""
        known = ~np.isnan(block.x[:, self.index]).any(axis=1)
        return known & ~np.isnan(block.column(self.status))

    def usable(self, block: Block, known: np.ndarray, cutoff: float) -> np.ndarray:
        keep = block.value <= cutoff
        if self.until is not None:
            keep &= cutoff < block.column(self.until)
        if self.complete and (keep & ~known).any():
            raise ValueError(f"missing values in the covariates of the {self.name} model")
        return keep & known


@dataclass(frozen=True)
class Jumps:
    """Baseline hazard jumps at the event times, in order; 0 at all others."""

    time: np.ndarray
    jump: np.ndarray

    def at(self, time: np.ndarray) -> np.ndarray:
        if not len(self.time):
            return np.zeros(len(time))
        place = np.minimum(np.searchsorted(self.time, time), len(self.time) - 1)
        return np.where(self.time[place] == time, self.jump[place], 0.0)


@dataclass(frozen=True)
class WeightModels:
    """Fitted numerator and denominator models of one exposure, for all cut-offs."""

    name: str
    status: str
    until: str
    numerator: tuple[int, ...]
    denominator: tuple[int, ...]
    numerator_beta: np.ndarray  # (cutoffs, terms)
    denominator_beta: np.ndarray
    numerator_jump: tuple[Jumps, ...]  # one for each cut-off
    denominator_jump: tuple[Jumps, ...]

    numerator_status: tuple[str, ...] = ()  # one for each cut-off
    denominator_status: tuple[str, ...] = ()

    def _log_probability(self, block, index, beta, jump, selected, exposed) -> np.ndarray:
        """log exp(-h) for rows that stay unexposed, log(1 - exp(-h)) for those that become exposed, else 0."""
        with np.errstate(over="ignore", divide="ignore"):
            log_hazard = np.log(jump.at(block.stop)) + linear(block.x[:, index], beta)
            hazard = np.exp(log_hazard)
            change = np.where(log_hazard < SMALL_HAZARD, log_hazard, np.log(-np.expm1(-hazard)))
        return np.where(selected, np.where(exposed, change, -hazard), 0.0)

    def log_weights(self, block: Block, cutoffs: np.ndarray, carry: dict | None = None) -> np.ndarray:
        """Logarithm of the running product of numerator / denominator over the rows of each stay.

        ``carry`` hands the sums of the last row of a block on to the next one.
        """
        exposed = block.column(self.status) == 1
        until = block.column(self.until)
        ratio = np.zeros((len(block.id), len(cutoffs)))
        for c, cutoff in enumerate(cutoffs):
            selected = (block.value <= cutoff) & (cutoff < until)
            top, bottom = (
                self._log_probability(block, index, beta[c], jump[c], selected, exposed)
                for index, beta, jump in (
                    (self.numerator, self.numerator_beta, self.numerator_jump),
                    (self.denominator, self.denominator_beta, self.denominator_jump),
                )
            )
            with np.errstate(invalid="ignore"):
                ratio[:, c] = top - bottom
        before = carry.get(self.name) if carry and block.continued else None
        total, lost = running_sums(ratio, block.rank, before)
        if carry is not None:
            carry[self.name] = total[-1], lost[-1]
        return total + lost

    def weights(self, block: Block, cutoffs: np.ndarray, carry: dict | None = None) -> np.ndarray:
        """Running product of numerator / denominator over the rows of each stay."""
        with np.errstate(over="ignore"):
            return np.exp(self.log_weights(block, cutoffs, carry))


def running_sums(
    values: np.ndarray, rank: np.ndarray, before: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the rows of each stay and what rounding took from them.

    ``rank`` is the place of a row in its stay; ``before`` are the sums that the first stay comes with.
    """
    total, lost = values.copy(), np.zeros_like(values)
    if before is not None:
        total[0], error = _add(before[0], values[0])
        lost[0] = before[1] + error
    for place in range(1, int(rank.max(initial=0)) + 1):
        rows = np.flatnonzero(rank == place)
        total[rows], error = _add(total[rows - 1], values[rows])
        lost[rows] = lost[rows - 1] + error
    return total, lost


def all_log_weights(
    block: Block, parts: tuple[WeightModels, ...], cutoffs: np.ndarray, carry: dict | None = None
) -> np.ndarray:
    """Logarithm of the product of all fitted weights, per row and cut-off."""
    total = np.zeros((len(block.id), len(cutoffs)))
    for part in parts:
        total += part.log_weights(block, cutoffs, carry)
    return total


def all_weights(
    block: Block,
    parts: tuple[WeightModels, ...],
    own: str | None,
    cutoffs: np.ndarray,
    shift: np.ndarray | None = None,
    carry: dict | None = None,
) -> np.ndarray:
    """Row weight for every cut-off: own weight column times all fitted weights, these over exp(``shift``) of the cut-off."""
    logs = all_log_weights(block, parts, cutoffs, carry)
    with np.errstate(over="ignore", invalid="ignore"):
        weight = np.exp(logs if shift is None else logs - shift)
    if own is not None:
        weight *= block.column(own)[:, None]
    return weight


@dataclass(frozen=True)
class ScoreParts:
    """Quantities of a finished fit at its event times, which the score residuals need."""

    beta: np.ndarray
    time: np.ndarray
    mean: np.ndarray  # (times, p) mean covariate at the events
    a: np.ndarray  # (times,) hazard of a row at risk
    v: np.ndarray  # (times, p)
    event_a: np.ndarray  # the same for a row that is an event at this time
    event_v: np.ndarray

    def residuals(self, x, event, start, stop) -> np.ndarray:
        """Score residual of each row, not weighted."""
        at = np.searchsorted(self.time, stop)
        known = at < len(self.time)
        known[known] = self.time[at[known]] == stop[known]
        event = event & known  # without weight at risk a time is not among them
        risk = np.exp(linear(x, self.beta))
        a, v = (np.concatenate([np.zeros((1, *part.shape[1:])), np.cumsum(part, axis=0)]) for part in (self.a, self.v))
        first = np.searchsorted(self.time, start, side="right")
        end = np.searchsorted(self.time, stop, side="right") - event
        out = -risk[:, None] * (x * (a[end] - a[first])[:, None] - (v[end] - v[first]))
        hits = np.flatnonzero(event)
        at = end[hits]
        own = x[hits] * self.event_a[at][:, None] - self.event_v[at]
        out[hits] += x[hits] - self.mean[at] - risk[hits][:, None] * own
        return out


class ScoreSums:
    """Outer products of the score sums of stays, for every cut-off; a stay may span blocks."""

    def __init__(self, layout: Layout, cuts: int) -> None:
        self.layout = layout
        self.out = np.zeros((cuts, len(layout.triangle[0])))
        self.open = np.zeros((cuts, layout.p))  # sums of the stay that is not finished

    def add(self, cut: int, block: Block, rows: np.ndarray, scores: np.ndarray) -> None:
        """Add the scores of the selected rows; called once for every block and cut-off."""
        stay = np.cumsum(block.rank == 0) - block.continued
        totals = np.zeros((stay[-1] + 1, self.layout.p))
        totals[0] = self.open[cut]
        which = stay[rows]
        if len(which):
            starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
            totals[which[starts]] += np.add.reduceat(scores, starts, axis=0)
        self.open[cut] = totals[-1]
        self._close(cut, totals[:-1])

    def _close(self, cut: int, totals: np.ndarray) -> None:
        self.out[cut] += (totals.T @ totals)[self.layout.triangle]

    def finished(self) -> np.ndarray:
        for cut, open_ in enumerate(self.open):
            self._close(cut, open_[None, :])
        return self.out


def add_vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Add the vectors of equal (model, cut) in one partition of partial sums."""
    totals: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for model, cut, vector in zip(batch["model"], batch["cut"], batch["sums"], strict=True):
            held = totals.get((model, cut))
            totals[model, cut] = np.array(vector) if held is None else held + vector
    if totals:
        model, cut = zip(*totals, strict=True)
        yield pd.DataFrame({"model": model, "cut": cut, "time": 0, "sums": list(totals.values())})

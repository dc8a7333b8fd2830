"""Suffix arrays over the words of a shard, and binary search of many suffixes in them."""

from __future__ import annotations

import numpy as np

from .words import LETTERS, Words, text_bytes


def suffix_array(rank: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes by their first ``depth`` words, by rank doubling.

    ``rank`` numbers the words from 1; ``left`` is the count of words from a place to the
    end of its text, which sorts before any further word.  Only tied suffixes are
    sorted again when the compared length doubles.
    """
    n = len(rank)
    top = int(rank.max(initial=0)) + 1
    step = 3 if top < 1 << 21 else 2
    bits = np.int64(21 if step == 3 else 31)
    key = rank.astype(np.int64)
    for k in range(1, step):
        ahead = np.zeros(n, np.int64)
        ahead[: n - k] = rank[k:]
        ahead[left <= k] = 0
        key = key << bits | ahead
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    place = np.empty(n, np.int64)
    place[order] = np.flatnonzero(new)[np.cumsum(new) - 1] if n else 0
    while step < depth:
        last = np.ones(n, bool)
        last[:-1] = new[1:]
        slots = np.flatnonzero(~(new & last))
        if not len(slots):
            break
        tied = order[slots]
        ahead = np.zeros(len(tied), np.int64)
        more = left[tied] > step
        ahead[more] = place[tied[more] + step] + 1
        pair = place[tied] << np.int64(32) | ahead
        by = np.argsort(pair)
        pair, tied = pair[by], tied[by]
        order[slots] = tied
        fresh = np.ones(len(tied), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        new[slots] = fresh
        place[tied] = slots[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        step *= 2
    return order


class Queries:
    """Test items cut into windows of ``window`` words; an item of fewer words is one window.

    Equal windows are searched once and know all items that hold them.
    """

    def __init__(self, items: list[tuple[str, str]], window: int):
        import pyarrow as pa

        items = sorted({(str(i), t) for i, t in items if i is not None and t})
        self.ids = sorted({i for i, _ in items})
        self.texts = [i for i, _ in items]  # the item of each text
        number = {x: k for k, x in enumerate(self.ids)}
        data, offsets = text_bytes(pa.array([t for _, t in items], pa.large_string()))
        self.words = Words(data, offsets, LETTERS)
        counts = np.diff(self.words.bounds)
        owner = np.array([number[i] for i, _ in items], np.int64)
        at, size, item = [], [], []
        for k, count in enumerate(counts):
            if count:
                starts = np.arange(max(1, count - window + 1)) + self.words.bounds[k]
                at.append(starts)
                size.append(np.full(len(starts), min(window, count)))
                item.append(np.full(len(starts), owner[k]))
        self.window = window
        self.depth = int(counts.max(initial=0))
        if not at:
            self.at = self.size = self.item_of = np.zeros(0, np.int64)
            self.item_from = np.zeros(1, np.int64)
            return
        at, size, item = map(np.concatenate, (at, size, item))
        spelled = [b" ".join(self.word(j) for j in range(a, a + s)) for a, s in zip(at, size, strict=True)]
        first: dict[bytes, int] = {}
        window_of = np.array([first.setdefault(s, len(first)) for s in spelled])
        pick = np.full(len(first), -1)
        pick[window_of[::-1]] = np.arange(len(at))[::-1]
        self.at, self.size = at[pick], size[pick]
        pairs = np.unique(np.stack([window_of, item], 1), axis=0)
        self.item_of = pairs[:, 1]
        self.item_from = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))

    def word(self, k: int) -> bytes:
        w = self.words
        return w.data[w.starts[k] : w.ends[k]].tobytes()


class Shard:
    """The suffix array of some texts, and the searches in it."""

    def __init__(self, words: Words, depth: int):
        self.words = words
        counts = np.diff(words.bounds)
        self.text_of = np.repeat(np.arange(len(counts)), counts)
        self.left = words.bounds[1:][self.text_of] - np.arange(len(self.text_of))
        self.vocabulary, rank = np.unique(words.hashes, return_inverse=True)
        self.rank = rank + 1
        self.order = suffix_array(self.rank, self.left, depth)

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Twice the rank of a known word; an odd number between its neighbours for others."""
        at = np.searchsorted(self.vocabulary, hashes)
        found = at < len(self.vocabulary)
        found[found] = self.vocabulary[at[found]] == hashes[found]
        return np.where(found, 2 * (at + 1), 2 * at + 1)

    def compare(self, places: np.ndarray, query: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple:
        """Sign of suffix against query words [at, at + size), and the count of equal words."""
        sign, same = np.zeros(len(places), np.int8), np.zeros(len(places), np.int64)
        live = np.arange(len(places))
        for k in range(int(size.max(initial=0))):
            ended = size[live] <= k
            live = live[~ended]
            short = self.left[places[live]] <= k
            sign[live[short]] = -1
            live = live[~short]
            if not len(live):
                break
            mine, theirs = 2 * self.rank[places[live] + k], query[at[live] + k]
            sign[live] = np.sign(mine - theirs)
            live = live[mine == theirs]
            same[live] += 1
        return sign, same

    def bound(self, query: np.ndarray, at: np.ndarray, size: np.ndarray, upper: bool) -> np.ndarray:
        """First slot of the order whose suffix is not less than (or is beyond) each query."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.order))
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                return low
            middle = (low[live] + high[live]) // 2
            sign, _ = self.compare(self.order[middle], query, at[live], size[live])
            below = sign <= 0 if upper else sign < 0
            low[live[below]] = middle[below] + 1
            high[live[~below]] = middle[~below]

    def occurrences(self, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
        """Word places at which a window begins, and the window; equal spelling is checked."""
        query = self.ranks(queries.words.hashes)
        low = self.bound(query, queries.at, queries.size, upper=False)
        there = np.flatnonzero(low < len(self.order))
        first, _ = self.compare(self.order[low[there]], query, queries.at[there], queries.size[there])
        there = there[first == 0]
        low = low[there]
        high = self.bound(query, queries.at[there], queries.size[there], upper=True)
        counts = high - low
        which = np.repeat(there, counts)
        slot = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
        places = self.order[slot]
        ok = self.spelled_alike(queries, places, which)
        return places[ok], which[ok]

    def spelled_alike(self, queries: Queries, places: np.ndarray, which: np.ndarray) -> np.ndarray:
        """False where words of equal hash differ in spelling."""
        ok = np.ones(len(places), bool)
        mine, theirs = self.words, queries.words
        for k in range(int(queries.size.max(initial=0))):
            live = np.flatnonzero(queries.size[which] > k)
            a, b = places[live] + k, queries.at[which[live]] + k
            size, other = mine.ends[a] - mine.starts[a], theirs.ends[b] - theirs.starts[b]
            ok[live[size != other]] = False
            at = 0
            while len(live):
                keep = (size == other) & (size > at)
                live, a, b, size, other = live[keep], a[keep], b[keep], size[keep], other[keep]
                differ = mine.chunks(mine.starts[a] + at, size - at) != theirs.chunks(theirs.starts[b] + at, size - at)
                ok[live[differ]] = False
                at += 8
        return ok

    def longest(self, queries: Queries, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every suffix of every item: its place there, the longest match and where it is.

        ``rank`` orders the texts; of all places of a longest match, that of the least rank, then the first in its text, is given.
        """
        words = queries.words
        counts = np.diff(words.bounds)
        at = np.arange(len(words.hashes))
        size = np.repeat(words.bounds[1:], counts) - at
        query = self.ranks(words.hashes)
        slot = self.bound(query, at, size, upper=False)
        best = np.zeros(len(at), np.int64)
        for near in (slot - 1, slot):
            live = np.flatnonzero((near >= 0) & (near < len(self.order)))
            _, same = self.compare(self.order[near[live]], query, at[live], size[live])
            best[live] = np.maximum(best[live], same)
        at, best = at[best > 0], best[best > 0]
        # the suffixes that begin with the match are neighbours
        runs = [self.bound(query, at, best, upper) for upper in (False, True)]
        runs, run_of = np.unique(np.stack(runs, 1), axis=0, return_inverse=True)
        order = np.lexsort((np.arange(len(self.left)) - self.words.bounds[self.text_of], rank[self.text_of]))
        turn = np.empty(len(order) + 1, np.int64)
        turn[order], turn[-1] = np.arange(len(order)), len(order)
        least = np.minimum.reduceat(turn[np.append(self.order, -1)], runs.ravel())[::2] if len(runs) else runs[:, 0]
        return at, best, order[least[run_of.ravel()]]

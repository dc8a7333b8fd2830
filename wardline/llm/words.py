"""Words and word hashes of many texts at once, on the bytes of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time inside a task; a longer single text is handled alone.
SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: After lower-casing: digits, a-z and every byte of a character beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[0x30:0x3A] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
#: Everything but ASCII white space.
VISIBLE = np.ones(256, bool)
VISIBLE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the n + 1 offsets; a null is an empty text."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts take at most ``limit`` bytes together, or single rows."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def leading(padded: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each place as a number, zero beyond the size."""
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    return eight[at] & _KEEP[np.minimum(size, 8)]


def range_hashes(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; eight bytes follow the last one."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    at, left = starts, ends - starts
    out = mix(leading(padded, at, left) ^ (left.astype(np.uint64) << np.uint64(56)))
    live = np.flatnonzero(left > 8)
    at, left = at[live] + 8, left[live] - 8
    while len(live):
        out[live] = mix(out[live] * _MIX[0] ^ leading(padded, at, left))
        keep = left > 8
        live, at, left = live[keep], at[keep] + 8, left[keep] - 8
    return out


class Words:
    """The words of some texts: starts and ends in ``data``, a hash each, and ``bounds`` by text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, letters: np.ndarray):
        size = len(data)
        padded = np.zeros(size + 8, np.uint8)
        np.take(_LOWER, data, out=padded[:size])
        inside = letters[padded[:size]]
        edge = np.zeros(size + 1, bool)
        edge[offsets] = True
        before = np.zeros(size + 1, bool)
        before[1:] = inside
        before &= ~edge
        self.data = padded
        self.starts = np.flatnonzero(inside & ~before[:size])
        after = np.zeros(size + 1, bool)
        after[:size] = inside
        after &= ~edge
        self.ends = np.flatnonzero(inside & ~after[1:]) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.hashes = range_hashes(self.data, self.starts, self.ends)

    def chunks(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return leading(self.data, at, size)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside a text, and the text of each run.

    A text with fewer words, but not none, gives one hash of its whole sequence.
    """
    counts = np.diff(words.bounds)
    of = np.repeat(np.arange(len(counts)), counts)
    h, n = words.hashes, len(words.hashes)
    left = words.bounds[1:][of] - np.arange(n) if n else np.zeros(0, np.int64)
    first = np.flatnonzero(left >= size)
    out = h[first] if len(first) else np.zeros(0, np.uint64)
    for k in range(1, size):
        out = mix(out * _MIX[0] ^ h[first + k])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if not len(short):
        return out, of[first]
    at, left = words.bounds[:-1][short], counts[short]
    whole = h[at] ^ mix(left.astype(np.uint64))
    for k in range(1, size - 1):
        live = left > k
        whole[live] = mix(whole[live] * _MIX[0] ^ h[at[live] + k])
    text = np.concatenate([of[first], short])
    order = np.argsort(text, kind="stable")
    return np.concatenate([out, whole])[order], text[order]

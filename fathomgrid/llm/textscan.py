"""Vectorised scanning of whole texts inside Arrow functions: bytes, words, rolling hashes, minima.

Texts arrive as Arrow batches. `pieces` cuts a batch into runs of whole documents of a few MB, so the NumPy
temporaries stay small whatever the batch holds; one document longer than that is a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
#: for scans that hold a dozen 64-bit values for every byte of a piece
SCAN_BYTES = 1 << 18
_SEED = 0x5EED

#: bytes that end a word: space, and tab to carriage return
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: bytes that end a word where punctuation doesn't count: all of ASCII but letters and digits
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the row offsets; a null row is empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, width)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[cuts[0]:cuts[-1]], cuts - cuts[0]


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about `limit` bytes."""
    data, cuts = text_buffer(column)
    row, n = 0, len(cuts) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(cuts, cuts[row] + limit, "right")) - 1)
        yield row, end, data[cuts[row]:cuts[end]], cuts[row:end + 1] - cuts[row]
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a fixed bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """64-bit hashes of any span of a sequence from prefix sums; families are independent of each other.

    Made once per task: the functions that use it travel to the workers by value, so nothing is kept in module globals.
    """

    def __init__(self, family: int = 0):
        rng = np.random.default_rng(_SEED + family)
        self.base = int(rng.integers(1, 1 << 62)) * 8 + 3
        self.inverse = pow(self.base, -1, 1 << 64)
        self.bytes = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("_up", self.base), ("_down", self.inverse)):
                steps = np.full(n, np.uint64(base & (2**64 - 1)))
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self._up, self._down

    def prefix(self, values: np.ndarray) -> np.ndarray:
        up, _ = self._powers(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:len(values)], out=sums[1:])
        return sums

    def spans(self, sums: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        _, down = self._powers(len(sums))
        return mix((sums[ends] - sums[starts]) * down[:len(sums)][starts])


@dataclass
class Words:
    """Words of a run of documents: byte span, document row within the run, and first word of each row."""
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray


def words(data: np.ndarray, cuts: np.ndarray, space: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that aren't in the table `space`, never across documents."""
    inside = ~space[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[cuts] = False
    opens = inside & ~before[:-1]
    last = np.ones(len(data), bool)
    last[:-1] = ~inside[1:]
    last[cuts[1:][cuts[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(opens), np.flatnonzero(inside & last) + 1
    first = np.searchsorted(starts, cuts)
    row = np.repeat(np.arange(len(cuts) - 1), np.diff(first))
    return Words(starts, ends, row, first)


def word_hashes(data: np.ndarray, w: Words, roll: Rolling, lower: bool = False) -> np.ndarray:
    table = roll.bytes[LOWER] if lower else roll.bytes
    return roll.spans(roll.prefix(table[data]), w.starts, w.ends)


def grams(hashes: np.ndarray, k: int, roll: Rolling) -> np.ndarray:
    """Hash of every `k` consecutive values, ignoring document borders (see `same_row`)."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    n = len(hashes) - k + 1
    return roll.spans(roll.prefix(hashes), slice(0, n), slice(k, n + k))


def same_row(row: np.ndarray, k: int) -> np.ndarray:
    """Whether the `k` values from each position belong to one document."""
    return row[k - 1:] == row[:len(row) - k + 1] if len(row) >= k else np.zeros(0, bool)


def sliding(values: np.ndarray, k: int, pick=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of every `k` consecutive values."""
    if len(values) < k:
        return values[:0]
    out, span = values, 1
    while span * 2 <= k:
        out = pick(out[:-span], out[span:])
        span *= 2
    rest = k - span
    return pick(out[:-rest], out[rest:]) if rest else out


def cover(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of `n` items lie within `k` items from any start."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + k, n), minlength=n + 1)
    return np.cumsum(edge[:n]) > 0

"""Vectorised text primitives used inside Arrow tasks.

A batch of texts is handled as one UTF-8 buffer with row offsets, in blocks of a
few megabytes, so temporary arrays stay small whatever the batch size.  A block
always holds whole texts; one text longer than the block size is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: ASCII A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words delimited by the six ASCII white-space characters.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words made of ASCII digits, lower-case letters and all non-ASCII characters.
ALNUM_LOWER = np.zeros(256, dtype=bool)
ALNUM_LOWER[0x30:0x3A] = ALNUM_LOWER[0x61:0x7B] = ALNUM_LOWER[0x80:] = True

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, key: str, n: int) -> np.ndarray:
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 2)
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if size <= 2 * BLOCK_BYTES:
            _powers[key] = out
        return out
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets (nulls are empty)."""
    column = column.cast(pa.large_utf8())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of consecutive runs of whole texts."""
    data, at = utf8(column)
    n, row = len(at) - 1, 0
    while row < n:
        end = min(n, max(row + 1, int(np.searchsorted(at, at[row] + size, side="right")) - 1))
        yield slice(row, end), data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


class Words:
    """Words of the texts in one block: starts, ends (byte positions) and per-row bounds."""

    def __init__(self, data: np.ndarray, at: np.ndarray, inside: np.ndarray):
        n = len(data)
        mask = inside[data]
        first = np.zeros(n + 1, dtype=bool)
        first[at] = True  # a text starts here, so no word continues over it
        gap = ~mask
        start = mask.copy()
        start[1:] &= gap[:-1] | first[1:-1]
        end = mask
        end[:-1] &= gap[1:] | first[1:-1]
        self.data = data
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.bounds = np.searchsorted(self.starts, at)
        self.counts = np.diff(self.bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which any span's polynomial hash follows in O(1)."""
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    value = data.astype(np.uint64)
    value += np.uint64(1)
    value *= _power(_P_INV, "inv", len(data) + 1)[: len(data)]
    np.cumsum(value, out=out[1:])
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes hash equally in every block."""
    sums = prefix_sums(data) if sums is None else sums
    raw = (sums[ends] - sums[starts]) * _power(_P, "pow", len(data) + 1)[ends]
    return mix(raw + (ends - starts).astype(np.uint64) * _M1)


def window_hashes(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k consecutive items that lie in one row: (hashes, index of the first item, row)."""
    n = len(hashes) - k + 1
    counts = np.maximum(np.diff(bounds) - k + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    if n <= 0 or not len(row):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), row
    at = np.repeat(bounds[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(len(row))
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out * _P + hashes[i : i + n])
    return out[at], at, row

"""Texts of an Arrow batch as flat byte arrays, without a Python object per text or word."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer single text is one block of its own.
BLOCK_BYTES = 960_000
#: An odd multiplier has an inverse modulo 2**64, so that the hash of any slice follows from two prefix sums.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes whose prefix sums are held at once.
PIECE = 1 << 20
_powers: dict[int, np.ndarray] = {}


class Block(NamedTuple):
    """Rows first to first + len(starts) of a batch: their bytes lie in data[starts[i]:ends[i]], with a free byte before and after each."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string column; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), offsets


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks of about `most` bytes, a byte 0x0A before each text and at the end."""
    data, offsets = flat(column)
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, rows)
        own = offsets[at : end + 1] - offsets[at]
        n = end - at
        out = np.full(int(own[-1]) + n + 1, 10, np.uint8)
        shift = np.arange(n, dtype=np.int64) + 1
        starts = own[:-1] + shift
        if n == 1:
            out[1:-1] = data[offsets[at] : offsets[end]]
        else:
            keep = np.ones(len(out), bool)
            keep[starts - 1] = False
            keep[-1] = False
            out[keep] = data[offsets[at] : offsets[end]]
        yield Block(at, out, starts, own[1:] + shift)
        at = end


def words(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that the 256-entry table marks."""
    mask = is_word[data].view(np.int8)
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    if len(mask) and mask[0]:
        edge = np.concatenate(([0], edge))
    if len(edge) % 2:
        edge = np.concatenate((edge, [len(mask)]))
    return edge[::2], edge[1::2]


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown by doubling and kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length() if n > 1 else 1)
        out = np.empty(size, np.uint64)
        out[0] = 1
        done = 1
        while done < size:
            out[done : 2 * done] = out[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        _powers[base] = have = out
    return have[:n]


def power_at(base: int, exponents: np.ndarray) -> np.ndarray:
    """base**exponent modulo 2**64 of each exponent, from two short tables."""
    low, high = exponents & 0xFFFF, exponents >> 16
    far = powers(pow(base, 1 << 16, 1 << 64), int(high.max()) + 1 if len(high) else 1)
    return powers(base, 1 << 16)[low] * far[high]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Prefix:
    """Hashes of any slices of data, from prefix sums of byte * BASE**position. For data of bounded length."""

    def __init__(self, data: np.ndarray):
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=self.sums[1:])
        self.inverse = powers(BASE_INVERSE, len(data) + 1)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each data[start:end]."""
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


class WordSpans:
    """Hashes of slices that begin and end with one of the ascending words data[starts[i]:ends[i]].

    The prefix sums are formed PIECE bytes at a time and kept at the words only, so that a text of any length takes
    some bytes for each of its words and none for each of its bytes. Hashes are those of Prefix.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.before, self.after = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
        carry = 0
        for low in range(0, len(data), PIECE):
            part = data[low : low + PIECE]
            sums = np.empty(len(part) + 1, np.uint64)
            sums[0] = 0
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(part)), out=sums[1:])
            sums = sums * np.uint64(pow(BASE, low, 1 << 64)) + np.uint64(carry)
            a, b = np.searchsorted(starts, (low, low + len(part)))
            self.before[a:b] = sums[starts[a:b] - low]
            a, b = np.searchsorted(ends, (low + 1, low + len(part) + 1))
            self.after[a:b] = sums[ends[a:b] - low]
            carry = int(sums[-1])
        self.inverse = power_at(BASE_INVERSE, starts)

    def words(self) -> np.ndarray:
        return mix((self.after - self.before) * self.inverse)

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes from each word `first` to the end of the word `last`."""
        return mix((self.after[last] - self.before[first]) * self.inverse[first])


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the ascending words data[start:end]."""
    return WordSpans(data, starts, ends).words()


def winnow(values: np.ndarray, window: int, group: np.ndarray) -> np.ndarray:
    """Marks each value that is the smallest (of equals the last) of some `window` adjacent ones of its group.

    Whether a value is marked depends on its neighbours alone, and of any `window` neighbours one is marked.
    """
    out = np.zeros(len(values), bool)
    n = len(values) - window + 1
    if n <= 0:
        return out
    best, least = np.arange(n), values[:n].copy()
    for step in range(1, window):
        near = values[step : step + n]
        lower = near <= least
        least = np.where(lower, near, least)
        best[lower] = np.flatnonzero(lower) + step
    out[best[group[:n] == group[window - 1 :]]] = True
    return out


def owner(starts: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Index of the text that each position lies in."""
    return np.searchsorted(starts, positions, "right") - 1

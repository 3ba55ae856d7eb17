"""Vectorised handling of Arrow text columns: blocks of whole documents as byte arrays, words, hashes.

Every function works on a block: the UTF-8 bytes of consecutive whole documents and the offsets between them.
A document is never cut; a block holds at least one document and about MAX_BLOCK bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MAX_BLOCK = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; a null counts as the empty text."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, most: int = MAX_BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of whole documents."""
    data, offsets = whole(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def lower_latin(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals U+00C0-U+00DE in lower case."""
    out = _LOWER[data]
    if len(out) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][second] += 32
    return out


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, which end at document borders."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = offsets[(offsets > 0) & (offsets < len(mask))]
    start, end = mask.copy(), mask.copy()
    keep = ~mask[:-1]
    start[1:] &= keep
    start[inner] = mask[inner]
    end[:-1] &= ~mask[1:]
    end[inner - 1] = mask[inner - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and the offsets of documents in them."""
    starts, ends = runs(~_SEPARATOR[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def _table(name: str, n: int) -> np.ndarray:
    """Powers of the base or of its inverse modulo 2**64."""
    if len(_powers.get(name, ())) < n:
        size = max(MAX_BLOCK + 1, n)
        filled = np.full(size, _U(_BASE if name == "up" else pow(_BASE, -1, 1 << 64)))
        filled[0] = 1
        _powers[name] = np.multiply.accumulate(filled)
    return _powers[name][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Hasher:
    """64-bit hashes of any substrings of a block, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        self.inverse = _table("down", len(data) + 1)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * _table("up", len(data)), out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(_U))


def owner(counts_offsets: np.ndarray) -> np.ndarray:
    """The document of each item, given the offsets of documents in the items."""
    return np.repeat(np.arange(len(counts_offsets) - 1), np.diff(counts_offsets))


def sums_by(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between offsets; 0 for an empty range."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


def code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return sums_by((data & 0xC0) != 0x80, offsets)

"""Vectorised text kernels shared by the corpus operators.

All kernels work on *slabs*: a few megabytes of UTF-8 text of consecutive rows
as one byte array plus row offsets.  A task streams its Arrow batches slab by
slab, so its memory is bounded by the slab size or by the longest single text.
Separators of every word definition here are ASCII, so words are cut on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLAB_BYTES = 1 << 20
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)


def _class_table(inside) -> np.ndarray:
    return np.array([inside(b) for b in range(256)], dtype=bool)


#: Words between white space: everything but space and the controls 9 to 13.
NOT_SPACE = _class_table(lambda b: b != 0x20 and not 9 <= b <= 13)
#: Words of letters and digits: ASCII letters and digits and all bytes of non-ASCII characters.
ALNUM = _class_table(lambda b: b >= 0x80 or chr(b).isalnum())


@dataclass
class Slab:
    """Rows ``first .. first + n`` of a batch: their bytes and n + 1 offsets into them."""

    first: int
    n: int
    buf: np.ndarray
    off: np.ndarray

    def text(self, i: int) -> str:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes().decode("utf-8", "replace")


def slabs(column: pa.Array, max_bytes: int = SLAB_BYTES) -> Iterator[Slab]:
    """Cut a string column into slabs of about max_bytes; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(off, off[at] + max_bytes, "right")) - 1
        to = min(max(to, at + 1), n)
        yield Slab(at, to - at, raw[off[at] : off[to]], off[at : to + 1] - off[at])
        at = to


@dataclass
class Words:
    """Words of a slab in text order: byte spans, row number, and per-row bounds into them."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    bound: np.ndarray

    def count(self) -> np.ndarray:
        return np.diff(self.bound)


def words(slab: Slab, inside: np.ndarray) -> Words:
    """Maximal runs of bytes of the class ``inside``; a row's end ends a run."""
    is_word = inside[slab.buf]
    opens = is_word.copy()
    opens[1:] &= ~is_word[:-1]
    closes = is_word.copy()
    closes[:-1] &= ~is_word[1:]
    cuts = slab.off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(is_word))]
    opens[cuts] = is_word[cuts]
    closes[cuts - 1] = is_word[cuts - 1]
    start = np.flatnonzero(opens)
    end = np.flatnonzero(closes) + 1
    bound = np.searchsorted(start, slab.off)
    return Words(start, end, np.repeat(np.arange(slab.n), np.diff(bound)), bound)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


_byte_values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_folded_values = _byte_values.copy()
_folded_values[65:91] = _byte_values[97:123]
_powers = {_BASE: np.ones(1, np.uint64), _BASE_INV: np.ones(1, np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers[base]
    if len(have) < n:
        have = np.full(max(n, SLAB_BYTES + 1), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * SLAB_BYTES:  # a longer text's powers aren't kept
            _powers[base] = have
    return have[:n]


def span_hashes(slab: Slab, start: np.ndarray, end: np.ndarray, fold: bool) -> np.ndarray:
    """64-bit hash of each byte span, with A-Z read as a-z if ``fold``.

    A polynomial hash from one prefix sum: the sum of value * base**position over
    the span, moved back to position 0 by the inverse power of its start.
    """
    if not len(start):
        return np.empty(0, np.uint64)
    sums = np.zeros(len(slab.buf) + 1, np.uint64)
    np.cumsum((_folded_values if fold else _byte_values)[slab.buf] * _power(_BASE, len(slab.buf)), out=sums[1:])
    h = (sums[end] - sums[start]) * _power(_BASE_INV, len(slab.buf) + 1)[start]
    return mix(h + (end - start).astype(np.uint64))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes, across rows too; len(h) - n + 1 values."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = out * np.uint64(_BASE) + h[j : len(h) - n + 1 + j]
    return mix(out)


def rows_of_grams(row: np.ndarray, n: int) -> np.ndarray:
    """Which n-grams lie in one row."""
    return row[: len(row) - n + 1] == row[n - 1 :] if len(row) >= n else np.empty(0, bool)


def row_sums(values: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Sum of values between consecutive bounds."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bound[1:]] - sums[bound[:-1]]


def char_count(slab: Slab) -> np.ndarray:
    """Prefix count of code points: entry i is how many begin before byte i."""
    sums = np.zeros(len(slab.buf) + 1, np.int64)
    np.cumsum((slab.buf & 0xC0) != 0x80, out=sums[1:])
    return sums

"""Vectorised words and word hashes over Arrow text columns.

Everything works on the UTF-8 bytes of whole texts. A text column is walked in
slices of about ``SLICE_BYTES`` so that the working arrays of a task stay small
whatever the batch size; a single longer text forms a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MULT_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_WINDOW = np.uint64(0xD6E8FEB86659FD93)
_WINDOW_INV = np.uint64(pow(int(_WINDOW), -1, 1 << 64))


def _lookup(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)])


#: Bytes of ``[^\x20\x09-\x0D]+``.
SPACED = _lookup(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z.
LETTERS = _lookup(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """Words of a slice of texts: byte spans, and where each text's words begin."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row, bytes, offsets) of runs of whole texts."""
    data, offsets = text_buffers(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = table[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(inside & (~before | cut))
    end = np.flatnonzero(before & (~inside | cut))
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        out = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if len(out) > 4 * SLICE_BYTES:
            return out
        _powers[name] = have = out
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    n = len(w.data)
    if not len(w.start):
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((w.data.astype(np.uint64) + np.uint64(1)) * _power("m", _MULT, n + 1)[:n], out=sums[1:])
    return mix((sums[w.end] - sums[w.start]) * _power("i", _MULT_INV, n + 1)[w.start] + (w.end - w.start).astype(np.uint64))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` values of h; the i-th run starts at i."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power("w", _WINDOW, len(h) + 1)[: len(h)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * _power("v", _WINDOW_INV, len(h) + 1)[:n])

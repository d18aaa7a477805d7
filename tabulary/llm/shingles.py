"""Word shingles of Arrow text columns and their XXH64 values, in numpy batches.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. A shingle is a
run of consecutive words joined by one space; a text of fewer words is one shingle, a
text without words has none. Repeats are kept. A text is never cut: a longer one than
a slice forms a slice of its own.
"""

from __future__ import annotations

import numpy as np
import xxhash

from tabulary.llm import bytewords as bw

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Longer inputs go to the library one by one.
_LONG = 256


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def _unaligned(data: np.ndarray, kind: str) -> np.ndarray:
    """The little-endian value at every byte offset; ``data`` is padded by at least eight bytes."""
    width = np.dtype(kind).itemsize
    return np.ndarray((len(data) - width + 1,), kind, data, strides=(1,))


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[start:end] for each pair; ``data`` must have eight spare bytes at its end."""
    size, seed = end - start, np.uint64(seed)
    w8, w4 = _unaligned(data, "<u8"), _unaligned(data, "<u4")
    out = np.full(len(start), seed) + _P5
    at = start.copy()
    wide = np.flatnonzero((size >= 32) & (size < _LONG))
    if len(wide):
        wide = wide[np.argsort(-size[wide], kind="stable")]
        stripes, p = size[wide] // 32, at[wide]
        v = [np.full(len(wide), seed) + x for x in (np.array(_P1) + np.array([_P2]), np.array([_P2]), np.zeros(1, np.uint64), ~np.array([_P1]) + np.uint64(1))]
        for k in range(int(stripes[0])):
            n = int(np.searchsorted(-stripes, -k))
            for i in range(4):
                v[i][:n] = _round(v[i][:n], w8[p[:n] + 32 * k + 8 * i])
        h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for x in v:
            h = (h ^ _round(np.zeros_like(x), x)) * _P1 + _P4
        out[wide] = h
        at[wide] = p + 32 * stripes
    out += size.astype(np.uint64)
    rest = end - at
    for k in range(3):
        i = np.flatnonzero((rest >= 8 * (k + 1)) & (size < _LONG))
        if not len(i):
            break
        out[i] = _rotl(out[i] ^ _round(np.uint64(0), w8[at[i] + 8 * k]), 27) * _P1 + _P4
    at += rest // 8 * 8
    rest %= 8
    i = np.flatnonzero((rest >= 4) & (size < _LONG))
    out[i] = _rotl(out[i] ^ (w4[at[i]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    at[i] += 4
    rest %= 4
    for k in range(3):
        i = np.flatnonzero((rest > k) & (size < _LONG))
        out[i] = _rotl(out[i] ^ (data[at[i] + k].astype(np.uint64) * _P5), 11) * _P1
    out = (out ^ (out >> np.uint64(33))) * _P2
    out = (out ^ (out >> np.uint64(29))) * _P3
    out = out ^ (out >> np.uint64(32))
    for i in np.flatnonzero(size >= _LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), int(seed))
    return out


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a slice's shingles, text after text, and where each text's begin (and the end)."""
    w = bw.find_words(data, offsets, bw.SPACED, lower=True)
    words = np.diff(w.first)
    count = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    if not len(w.start):
        return np.zeros(0, np.uint64), first
    # The words with one space after each: a shingle is a stretch of these bytes.
    size = w.end - w.start
    begin = np.cumsum(size + 1) - size - 1
    inside = bw.SPACED[w.data]
    joined = np.full(int(begin[-1] + size[-1]) + 9, 32, np.uint8)
    joined[np.arange(int(inside.sum())) + np.repeat(np.arange(len(size)), size)] = w.data[inside]
    doc = np.repeat(np.arange(len(words)), count)
    head = w.first[doc] + np.arange(first[-1]) - first[doc]
    last = np.minimum(head + width, w.first[doc + 1]) - 1
    return xxh64(joined, begin[head], begin[last] + size[last], seed), first


def word_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of a slice's shingles, repeats included, and where each text's begin (and the end)."""
    w = bw.find_words(data, offsets, bw.SPACED, lower=True)
    words, h = np.diff(w.first), bw.word_hashes(w)
    count = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(first[-1], np.uint64)
    doc = np.repeat(np.arange(len(words)), count)
    head = w.first[doc] + np.arange(first[-1]) - first[doc]
    whole = words[doc] >= width
    out[whole] = bw.window_hashes(h, width)[head[whole]]
    for d in np.flatnonzero((words > 0) & (words < width)).tolist():
        out[first[d]] = bw.window_hashes(h[w.first[d] : w.first[d + 1]], int(words[d]))[0]
    return out, first

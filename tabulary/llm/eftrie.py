"""An n-gram trie in Elias-Fano form, written to a file and memory-mapped.

Every level holds the successors of its contexts, one list after the other, each sorted.
Where a context's list begins is a monotone sequence, kept as Elias-Fano: low bits as
they are, high bits in unary. An entry has a quantised smoothed probability and, as the
context of the next level, a quantised weight that it gives to the shorter history. A
successor is searched for in its context's stretch only; the place where it is found is
its number as a context of the next level.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Values from 1 down to 10 ** -RANGE are kept in codes 1 to 65535; code 0: none.
RANGE = 16
_STEPS = 65534
ABSENT = 0


def quantise(p: np.ndarray) -> np.ndarray:
    level = np.rint(-np.log10(np.maximum(p, 10.0**-RANGE)) * (_STEPS / RANGE))
    return np.where(p > 0, 1 + np.clip(level, 0, _STEPS), ABSENT).astype(np.uint16)


_TABLE = 10.0 ** (-(np.arange(_STEPS + 2) - 1) * (RANGE / _STEPS))
_TABLE[ABSENT] = 0.0


def dequantise(code: np.ndarray) -> np.ndarray:
    return _TABLE[code]


class EliasFano:
    """A monotone sequence of unsigned integers with access by place."""

    def __init__(self, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.low, self.high, self.before = low, high, before

    @staticmethod
    def encode(values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        ratio = (int(values[-1]) + 1) // n if n else 1
        size = max(0, ratio.bit_length() - 1) // 8
        shift = np.uint64(8 * size)
        low = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :size].copy()
        at = (values >> shift).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(at[-1]) // 64 + 1 if n else 1) * 64, np.uint8)
        bits[at] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])
        return EliasFano(low, high, before)

    def access(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, i, side="right") - 1
        rest = np.asarray(i) - self.before[word]
        bits = np.asarray(self.high[word])
        place = np.zeros(len(rest), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            part = (bits >> place.astype(np.uint64)) & np.uint64((1 << width) - 1)
            ones = np.bitwise_count(part).astype(np.int64)
            up = rest >= ones
            rest = np.where(up, rest - ones, rest)
            place += np.where(up, width, 0)
        value = word * 64 + place - i
        for k in range(self.low.shape[1] - 1, -1, -1):
            value = (value << 8) | self.low[i, k]
        return value


class Trie:
    """Levels of (contexts, keys, codes), memory-mapped until ``close``.

    keys: sorted distinct (context << 32 | successor); codes: one for each key. A
    level's contexts are numbered from 0.
    """

    def __init__(self, levels: list[tuple[int, np.ndarray, np.ndarray]]):
        parts = []
        for contexts, keys, code in levels:
            ends = np.searchsorted(keys, np.arange(contexts + 1, dtype=np.uint64) << np.uint64(32))
            begins = EliasFano.encode(ends)
            parts.append({"low": begins.low, "high": begins.high, "before": begins.before, "next": keys.astype(np.uint32), "code": code})
        self._file = tempfile.TemporaryFile(prefix="trie-")  # noqa: SIM115  has no name, so it goes with the task
        places, at = [], 0
        for part in parts:
            for a in part.values():
                places.append((at, a.dtype, a.shape))
                self._file.write(a.tobytes() + b"\0" * (8 - a.nbytes % 8))
                at += a.nbytes + 8 - a.nbytes % 8
        self._file.flush()
        whole = np.memmap(self._file, np.uint8, "r")
        views = iter([whole[o : o + d.itemsize * int(np.prod(s))].view(d).reshape(s) for o, d, s in places])
        self.levels = [(EliasFano(next(views), next(views), next(views)), next(views), next(views)) for _ in parts]

    def close(self) -> None:
        self.levels = []
        self._file.close()

    def find(self, level: int, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Place of each successor in its context's list, -1 where it was never seen there or the context is -1."""
        begins, following, _ = self.levels[level]
        known = np.flatnonzero(context >= 0)
        out = np.full(len(context), -1, np.int64)
        context, successor = context[known], successor[known]
        lo, hi = begins.access(context), begins.access(context + 1)
        end = hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = following[mid] < successor[live]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        some = np.flatnonzero(lo < end)
        hit = some[following[lo[some]] == successor[some]]
        out[known[hit]] = lo[hit]
        return out

    def codes(self, level: int, place: np.ndarray) -> np.ndarray:
        code = self.levels[level][2]
        return np.where(place >= 0, code[np.maximum(place, 0)] if len(code) else ABSENT, ABSENT).astype(np.uint16)

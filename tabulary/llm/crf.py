"""A linear-chain conditional random field over word shapes, in numpy batches.

A token's features are table rows: its shape, its known word (0: unknown), the same
of the tokens before and after it, and the known words two tokens off. Capitals are those
of Unicode's two-byte range too. Words of one list share a row, which holds for
capitalised words only. Scores are sums of eight looked-up rows per label plus a
label-to-label matrix. Training maximises the penalised
likelihood of a small labelled table; all sentences advance together through
forward-backward. Decoding runs Viterbi over all sequences of a batch at once,
the step at time t taking the sequences that are longer than t.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tabulary.llm import bytewords as bw

LABELS = ("O", "B-name", "I-name", "B-address", "I-address")
_SHAPES = 2 * 2 * 2 * 4 * 3 * 3

_TRAIL = np.isin(np.arange(256), np.frombuffer(b".,;:!?)\"'", np.uint8))
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#$%&*|<>@=_/\\{}[]~^", np.uint8))
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?\n", np.uint8))
_UPPER = np.zeros(1 << 16, bool)
_UPPER[65:91] = True
for _c in range(0x80, 0x800):
    if chr(_c).isupper():
        _UPPER[int.from_bytes(chr(_c).encode())] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _upper(data: np.ndarray) -> np.ndarray:
    """Marks the first byte of each capital letter."""
    wide = data.astype(np.uint16)
    pair = (wide << np.uint16(8)) | np.append(wide[1:], np.uint16(0))
    return np.where(data >= 0xC0, _UPPER[pair], _UPPER[wide])


def _counts(mark: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mark)])
    return sums[end] - sums[start]


@dataclass
class Tokens:
    """Spans of trimmed tokens (bytes), their shape and known word, and their sequences."""

    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray
    word: np.ndarray
    first: np.ndarray
    words: bw.Words


def tokens(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> Tokens:
    """Tokens of whole texts. A sequence ends with a text, a line, or a token that ends a
    sentence; the full stop of a known title or of one capital ends none."""
    w = bw.find_words(data, offsets, bw.SPACED)
    n = len(w.start)
    if not n:
        return Tokens(w.start, w.end, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), w)
    end = w.end.copy()
    for _ in range(2):
        end -= _TRAIL[data[end - 1]] & (end - w.start > 1)
    trimmed = bw.Words(bw._LOWER[data], offsets, w.start, end, w.first)
    h = bw.word_hashes(trimmed)
    upper_at, letters = _upper(data), (data & 0xC0) != 0x80
    upper_first = upper_at[w.start]
    word = lexicon.rows(h, upper_first)
    size = _counts(letters, w.start, end)
    upper, digit = _counts(upper_at, w.start, end), _counts(_DIGIT[data], w.start, end)
    kind = np.where(digit == 0, 0, np.where(digit == size, 1, np.where(_DIGIT[data[w.start]], 2, 3)))
    kind = np.where(_counts(_SYMBOL[data], w.start, w.end) > 0, 3, kind)
    case = np.where(upper == 0, 0, np.where(upper == size, 2, 1))
    length = np.digitize(size, [2, 5])
    again = np.zeros(n, bool)
    again[1:] = h[1:] == h[:-1]
    shape = ((((again * 2 + upper_first) * 2 + (end < w.end)) * 4 + kind) * 3 + case) * 3 + length
    stop = _STOP[data[w.end - 1]] & ~np.isin(h, lexicon.titles) & ~(upper_first & (size == 1) & (w.end - end == 1) & (data[w.end - 1] == 46))
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    cut = np.zeros(n, bool)
    cut[w.first[w.first < n]] = True
    cut[1:] |= stop[:-1] | (lines[w.start[1:]] != lines[w.end[:-1]])
    return Tokens(w.start, end, shape, word, np.append(np.flatnonzero(cut), n), w)


class Lexicon:
    """Known words by hash, and the row that each has in the word tables; 0: unknown."""

    def __init__(self, own: set[str], lists: list[set[str]], titles: tuple[str, ...]):
        self.titles = _hashes(titles)
        single = sorted(own)
        row = {w: k for k, words in enumerate(lists, 1) for w in words} | {w: k for k, w in enumerate(single, len(lists) + 1)}
        names = list(row)
        found = np.array([_hashes([w])[0] for w in names], np.uint64)
        order = np.argsort(found)
        self.known, self.row, self.shared = found[order], np.array([row[w] for w in names])[order], len(lists)
        self.size = len(single) + len(lists) + 1

    def rows(self, h: np.ndarray, capital: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        row = np.where(self.known[at] == h, self.row[at], 0)
        return np.where((row <= self.shared) & ~capital, 0, row)


class Model:
    """Feature tables (8 of rows x labels) and the label-to-label matrix."""

    def __init__(self, lexicon: Lexicon):
        k = len(LABELS)
        self.lexicon = lexicon
        rows = [_SHAPES, lexicon.size] + [_SHAPES + 1, lexicon.size + 1] * 2 + [lexicon.size + 1] * 2
        self.tables = [np.zeros((r, k), np.float32) for r in rows]
        self.step = np.zeros((k, k), np.float32)

    def features(self, t: Tokens) -> list[np.ndarray]:
        """Row numbers in each table; the last row of a neighbour's table stands for none."""
        n, none = len(t.shape), self.lexicon.size
        if not n:
            return [t.shape] * len(self.tables)
        head, tail = np.zeros(n, bool), np.zeros(n, bool)
        head[t.first[:-1]] = True
        tail[t.first[1:] - 1] = True
        out, far = [t.shape, t.word], []
        for gone, by in ((head, 1), (tail, -1)):
            word = np.where(gone, none, np.roll(t.word, by))
            out += [np.where(gone, _SHAPES, np.roll(t.shape, by)), word]
            far.append(np.where(gone, none, np.roll(word, by)))
        return out + far

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        out = self.tables[0][rows[0]]
        for table, r in zip(self.tables[1:], rows[1:], strict=True):
            out = out + table[r]
        return out

    def decode(self, t: Tokens) -> np.ndarray:
        """The best label of every token."""
        n, k = len(t.shape), len(LABELS)
        best = np.zeros(n, np.int8)
        if not n:
            return best
        emit = self.scores(self.features(t))
        size = np.diff(t.first)
        order = np.argsort(-size, kind="stable")
        begin, size = t.first[:-1][order], size[order]
        back = np.zeros((n, k), np.int8)
        now = emit[begin]
        last = now.copy()
        for i in range(1, int(size[0])):
            alive = int(np.searchsorted(-size, -i))
            via = now[:alive, :, None] + self.step[None]
            at = begin[:alive] + i
            back[at] = via.argmax(axis=1)
            now = via.max(axis=1) + emit[at]
            last[:alive] = now
        label = last.argmax(axis=1)
        for i in range(int(size[0]) - 1, -1, -1):
            alive = int(np.searchsorted(-size, -i))
            at = begin[:alive] + i
            ends = size[:alive] == i + 1
            here = np.where(ends, label[:alive], best[np.minimum(at + 1, n - 1)])
            if i + 1 < int(size[0]):
                here = np.where(ends, label[:alive], back[np.minimum(at + 1, n - 1), here])
            best[at] = here
        return best


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def train(table: list[tuple[list[str], list[str]]], lexicon: Lexicon, rounds: int = 80, rate: float = 0.15, penalty: float = 0.02) -> Model:
    """A model from (tokens, labels) sentences."""
    table = [(w, y) for w, y in table if w]
    data = np.frombuffer("\n".join(" ".join(w) for w, _ in table).encode(), np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    offsets = np.concatenate([[0], ends, [len(data)]])
    model = Model(lexicon)
    t = tokens(data, offsets, lexicon)
    t.first = t.words.first  # a labelled sentence is one sequence
    gold = np.array([LABELS.index(l) for _, y in table for l in y])
    rows = model.features(t)
    size = np.diff(t.first)
    width, k = int(size.max()), len(LABELS)
    grid = np.minimum(t.first[:-1, None] + np.arange(width), len(gold) - 1)
    real = np.arange(width) < size[:, None]
    params = [*model.tables, model.step]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    one = np.eye(k)
    pairs = np.zeros((k, k))
    np.add.at(pairs, (gold[grid[:, :-1]][real[:, 1:]], gold[grid[:, 1:]][real[:, 1:]]), 1)
    for r in range(1, rounds + 1):
        emit = model.scores(rows).astype(float)[grid]
        step = model.step.astype(float)
        a = [emit[:, 0]]
        for i in range(1, width):
            a.append(np.where(real[:, i, None], _logsum(a[-1][:, :, None] + step, 1) + emit[:, i], a[-1]))
        total = _logsum(a[-1], 1)
        b = [np.zeros_like(a[0])]
        for i in range(width - 1, 0, -1):
            b.insert(0, np.where(real[:, i, None], _logsum(step[None] + (emit[:, i] + b[0])[:, None, :], 2), b[0]))
        marginal = np.zeros((len(gold), k))
        joint = np.zeros((k, k))
        for i in range(width):
            m = np.exp(a[i] + b[i] - total[:, None])
            marginal[grid[real[:, i], i]] = m[real[:, i]]
            if i:
                p = np.exp(a[i - 1][:, :, None] + step + (emit[:, i] + b[i])[:, None, :] - total[:, None, None])
                joint += p[real[:, i]].sum(axis=0)
        slope = []
        for table_, row in zip(model.tables, rows, strict=True):
            g = np.zeros(table_.shape)
            np.add.at(g, row, one[gold] - marginal)
            slope.append(g - penalty * table_)
        slope.append(pairs - joint - penalty * model.step)
        for p, g, m, v in zip(params, slope, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
    return model


def _hashes(words) -> np.ndarray:
    out = []
    for w in words:
        data = np.frombuffer(w.encode(), np.uint8)
        out.append(bw.word_hashes(bw.Words(data, np.array([0, len(data)]), np.array([0]), np.array([len(data)]), np.array([0, 1])))[0])
    return np.unique(np.array(out, np.uint64))

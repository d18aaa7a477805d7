"""Ids of a byte-level byte-pair vocabulary over Arrow text columns.

Such a vocabulary merges bytes within pre-tokens only: a contraction, a run of letters, of
digits or of other signs with one space before it, or white space. Their bounds are found
in numpy over the code points of a whole slice; each distinct pre-token is given to the
tokenizers library once, and its ids are copied to every place. Texts that hold a special
token's string go to the library whole. A memory of ``MEMORY`` distinct pre-tokens goes
from slice to slice; when it is full it begins anew, which changes no id. Pre-tokens are
told apart by a 64-bit hash and their length.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from tabulary.llm import bytewords as bw

MEMORY = 1 << 20
_OTHER, _LETTER, _DIGIT, _SPACE = range(4)


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    table = np.zeros(0x110000, np.uint8)
    at = np.array(points)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            table[at[m.start() : m.end()]] = kind
    return table


def pretokens(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in the code points of texts that begin at ``offsets`` (the end included)."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    head = np.zeros(n + 1, bool)
    head[offsets] = True
    last = head[1:]
    head = head[:n]
    begin = head.copy()
    begin[1:] |= kind[1:] != kind[:-1]
    # Of white space before something else, the last character stands alone or, a space, goes with what follows.
    before = np.flatnonzero((kind == _SPACE) & ~last)
    before = before[kind[before + 1] != _SPACE]
    begin[before] = True
    joined = before[points[before] == 32]
    begin[joined + 1] = False
    # 's 't 'm 'd 're 've 'll, where the apostrophe begins a pre-token and letters follow.
    quote = np.flatnonzero(begin & (points == 39) & ~last)
    quote = quote[kind[quote + 1] == _LETTER]
    one = points[quote + 1]
    more = ~last[quote + 1]
    two = np.where(more, points[np.minimum(quote + 2, n - 1)], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for at, size in ((quote[short], 2), (quote[long & ~short], 3)):
        begin[at + 1] = False
        after = at[~last[at + size - 1]] + size
        begin[after] = True
    return np.flatnonzero(begin)


class Vocabulary:
    """A tokenizer file and the ids of the pre-tokens met so far."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.line_break = self.library.encode("\n", add_special_tokens=False).ids[0]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = np.zeros(0, np.int64)
        self.edge = np.zeros(1, np.int64)

    def _learn(self, names: np.ndarray, texts: list[str]) -> None:
        """Ids of new pre-tokens; all but white space are given to the library as lines of one text,
        for a line break is a pre-token of its own before and after them."""
        blank = [i for i, t in enumerate(texts) if t.isspace()]
        lines = "\n".join(t for t in texts if not t.isspace())
        ids = np.array(self.library.encode_batch_fast([lines], add_special_tokens=False)[0].ids, np.int64)
        breaks = np.flatnonzero(ids == self.line_break)
        sizes = np.diff(np.concatenate([[-1], breaks, [len(ids)]])) - 1
        kept = np.delete(ids, breaks)
        if blank:
            rest = [i for i in range(len(texts)) if not texts[i].isspace()]
            parts = dict(zip(rest, np.split(kept, np.cumsum(sizes)[:-1]), strict=False))
            found = self.library.encode_batch_fast([texts[i] for i in blank], add_special_tokens=False)
            parts |= {i: np.array(e.ids, np.int64) for i, e in zip(blank, found, strict=True)}
            kept, sizes = np.concatenate([parts[i] for i in range(len(texts))]), np.array([len(parts[i]) for i in range(len(texts))])
        self.known |= zip(names.tolist(), range(len(self.edge) - 1, len(self.edge) - 1 + len(texts)), strict=True)
        self.edge = np.concatenate([self.edge, self.edge[-1] + np.cumsum(sizes, dtype=np.int64)])
        self.ids = np.concatenate([self.ids, kept])

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special strings, and where each text's begin (and the end)."""
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        start = pretokens(points, offsets)
        end = np.append(start[1:], len(points))
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        words = bw.Words(points, offsets, start, end, np.searchsorted(start, offsets))
        names, place, inverse = np.unique(bw.word_hashes(words), return_index=True, return_inverse=True)
        if len(self.known) + len(names) > MEMORY:
            self._forget()
        row = np.array([self.known.get(h, -1) for h in names.tolist()], np.int64)
        if len(new := np.flatnonzero(row < 0)):
            row[new] = len(self.edge) - 1 + np.arange(len(new))
            self._learn(names[new], [whole[start[p] : end[p]] for p in place[new].tolist()])
        row = row[inverse]
        size = (self.edge[1:] - self.edge[:-1])[row]
        edge = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.edge[row] - edge[:-1], size) + np.arange(edge[-1])]
        return ids, edge[words.first]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, one after the other, and where each text's begin (and the end)."""
        odd = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        if not odd:
            return self._plain(texts)
        given = dict(zip(odd, self.library.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False), strict=True))
        ids, edge = self._plain(["" if i in given else t for i, t in enumerate(texts)])
        parts = [np.array(given[i].ids, np.int64) if i in given else ids[edge[i] : edge[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def text_slices(column: pa.Array, size: int = bw.SLICE_BYTES):
    """Yield (first row, last row, texts) of runs of whole texts; a null text is empty."""
    for lo, hi, _, _ in bw.slices(column, size):
        yield lo, hi, [t or "" for t in column.slice(lo, hi - lo).to_pylist()]

"""Language-model scoring on a trigram trie that is built and queried in shards.

A block is a stretch of one partition's documents. It sends each shard the distinct
words, pairs and triples that belong there, with their training counts; so whatever a
word's frequency, a block sends it once, and a block and a shard that share nothing send
nothing. A shard is one task: it adds up the counts, builds its part of the trie
(``eftrie``), looks up what the blocks asked for and answers in the order of the
question. Back at the block, answers and tokens give every document's score.

A pair lives in the shard of its first word, a triple in that of its pair. Contexts (words
or pairs) with more than half a shard's share of all tokens are spread over several
shards by their successors, and their totals are summed by Spark; their number is bounded
by the number of shards. That list comes from a fiftieth of the texts and, like the
number of shards, only decides where n-grams are sent; results do not depend on it.

The model is interpolated Witten-Bell of order 3:
P(w|uv) = (c(uvw) + k(uv) P(w|v)) / (c(uv) + k(uv)), c(uv) how often something follows uv and
k(uv) of how many kinds; P(w|v) likewise over P(w), the absolutely discounted share of w, the
discount spread evenly over all words and one unknown. A context never seen passes the
shorter one on. Every document starts after a start mark, which is a context of its own,
and ends with an end token. All counts are exact and cover all training documents;
probabilities and weights are kept in 16 bits, which moves each by 0.0003 at most in log10.
Words are told apart by a 64-bit hash; inside a shard they are numbered.

Blocks are recognised by their content. The input must give the same rows in the
same order when a task reads it again, as tables do; a difference stops the run
with an error instead of giving other scores. Defined results: null and empty
texts are the end token alone; a very long text is a block of its own; rows with equal or
null ids stay separate; with no training documents all counts are zero; an empty table
gives none. Columns other than the id and the text are not read, so names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.llm import bytewords as bw
from tabulary.llm import eftrie
from tabulary.llm.arrowmap import held_until_done, written

#: Text bytes of a block, and tokens of a shard if the shuffle has no more partitions.
BLOCK_BYTES = 4 << 20
SHARD_TOKENS = 2_000_000
DISCOUNT = 0.5
_SAMPLE, _FREQUENT = 50, 60_000
_START, _END = np.uint64(0x5354415254), np.uint64(0x454E44)
_LOW = np.uint64((1 << 32) - 1)
_BLOCK_ROW = -1
_ROW = "shard int, block long, payload binary"
#: Successors of spread contexts keep their count instead of a share: in units that every count fits.
_UNIT = 1e-15


def _small(a: np.ndarray) -> np.ndarray:
    """Unsigned integers in as few bytes as they need."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([[a.dtype.itemsize, len(a)] for a in arrays], np.int64)
    return np.int64(len(arrays)).tobytes() + head.tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpack(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    out, at = [], 8 + 16 * n
    for width, size in np.frombuffer(data, np.int64, 2 * n, 8).reshape(n, 2).tolist():
        out.append(np.frombuffer(data, f"<u{width}", size, at))
        at += width * size
    return out


def _pair_names(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Names of pairs as contexts."""
    return bw.mix(u * np.uint64(0x9E3779B97F4A7C15) + bw.mix(v + np.uint64(1)))


def _shards_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (bw.mix(h ^ np.uint64(0x9E3779B9)) % np.uint64(shards)).astype(np.int64)


class Busy:
    """Contexts whose successors are spread, sorted by name, and over how many shards; and the
    frequent words that messages name by their place in this list."""

    def __init__(self, names: list[int], parts: list[int], frequent: list[int] = ()):
        self.frequent = np.sort(np.array(frequent, np.uint64))
        order = np.argsort(np.array(names, np.uint64))
        self.names, self.parts = np.array(names, np.uint64)[order], np.array(parts, np.int64)[order]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each name in the list, or -1."""
        if not len(self.names):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.names, h), len(self.names) - 1)
        return np.where(self.names[at] == h, at, -1)

    def spread(self, home: np.ndarray, spot: np.ndarray, successor: np.ndarray, shards: int) -> np.ndarray:
        """Shards of entries by the ``home`` and ``spot`` of their context and the name of their successor."""
        to, hot = home.copy(), np.flatnonzero(spot >= 0)
        to[hot] = (to[hot] + 1 + (bw.mix(successor[hot]) >> np.uint64(40)).astype(np.int64) % self.parts[spot[hot]]) % shards
        return to


def _planes(x: np.ndarray) -> np.ndarray:
    """Sorted names byte by byte: their upper bytes hardly change, which packers make use of."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).ravel()


def _from_planes(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.reshape(8, -1).T).view("<u8").ravel()


class Block:
    """Words, pairs and triples of a block, and where and in which order they are sent.

    Local words are numbered by hash. ``tokens`` numbers each document's words and its end
    token; ``pair`` and ``triple`` (-1 for first tokens) number each token's distinct n-gram.
    """

    def __init__(self, names: np.ndarray, tokens: np.ndarray, length: np.ndarray, busy: Busy, shards: int):
        self.names, self.tokens, self.length = names, tokens, length
        first = np.cumsum(length) - length
        context = np.empty(len(tokens), np.uint64)
        context[1:] = tokens[:-1]
        context[first] = np.searchsorted(names, _START)
        pairs, self.pair = np.unique((context << np.uint64(32)) | tokens.astype(np.uint64), return_inverse=True)
        self.context, self.word = (pairs >> np.uint64(32)).astype(np.int64), (pairs & _LOW).astype(np.int64)
        inner = np.ones(len(tokens), bool)
        inner[first] = False
        at = np.flatnonzero(inner)
        triples, which = np.unique((self.pair[at - 1].astype(np.uint64) << np.uint64(32)) | tokens[at].astype(np.uint64), return_inverse=True)
        self.triple = np.full(len(tokens), -1, np.int64)
        self.triple[at] = which
        self.below, self.third = (triples >> np.uint64(32)).astype(np.int64), (triples & _LOW).astype(np.int64)
        self.home, self.spot = _shards_of(names, shards), busy.find(names)
        at = np.minimum(np.searchsorted(busy.frequent, names), max(len(busy.frequent) - 1, 0))
        self.code = np.where(busy.frequent[at] == names, at, -1) if len(busy.frequent) else np.full(len(names), -1)
        of_pair = _pair_names(names[self.context], names[self.word])
        self.pair_spot = busy.find(of_pair)
        self.guest2, self.guest3 = self.spot[self.context] >= 0, self.pair_spot[self.below] >= 0
        to2 = busy.spread(self.home[self.context], self.spot[self.context], names[self.word], shards)
        # A spread pair's triples start from its own home, all others live where their pair does.
        home3 = np.where(self.guest3, _shards_of(of_pair, shards)[self.below], to2[self.below])
        to3 = busy.spread(home3, self.pair_spot[self.below], names[self.third], shards)
        self.order1 = np.argsort(self.home, kind="stable")
        self.order2 = np.lexsort((self.guest2, to2))
        self.rank = np.empty(len(pairs), np.int64)
        self.rank[self.order2] = np.arange(len(pairs))
        self.order3 = np.lexsort((self.rank[self.below], self.guest3, to3))
        edges = np.arange(shards + 1)
        self.cuts = [np.searchsorted(x, edges) for x in (self.home[self.order1], to2[self.order2], to3[self.order3])]

    def part(self, s: int) -> list[np.ndarray]:
        """Local words, pairs and triples of a shard, in order."""
        return [order[cut[s] : cut[s + 1]] for order, cut in zip((self.order1, self.order2, self.order3), self.cuts, strict=True)]

    def message(self, s: int, counts: list[np.ndarray]) -> bytes | None:
        """What the block asks of a shard, its training counts included; words are numbered in the message's own list."""
        own, p, t = self.part(s)
        if not len(own) and not len(p) and not len(t):
            return None
        g2, g3 = self.guest2[p], self.guest3[t]
        n_own = np.bincount(np.searchsorted(own, self.context[p[~g2]]), minlength=len(own))
        far2, n_far2 = np.unique(self.context[p[g2]], return_counts=True)
        n_third = np.bincount(self.rank[self.below[t[~g3]]] - self.cuts[1][s], minlength=len(p))
        guests = self.below[t[g3]]
        head = np.flatnonzero(np.diff(guests, prepend=-1))
        far3, n_far3 = guests[head], np.diff(np.append(head, len(guests)))
        words = [own, far2, self.word[p], self.context[far3], self.word[far3], self.third[t]]
        used = np.unique(np.concatenate(words))
        code = self.code[used]
        listed = code >= 0
        place = np.where(listed, np.cumsum(listed) - 1, listed.sum() + np.cumsum(~listed) - 1)
        lists = [_small(place[np.searchsorted(used, w)]) for w in words]
        numbers = [_small(x) for x in (counts[0][own], n_own, n_far2, counts[1][p], n_third, n_far3, counts[2][t])]
        return _pack(_small(code[listed]), _planes(self.names[used[~listed]]), *lists, *numbers)


def _blocks(batches: Iterator[pa.RecordBatch], busy: Busy, shards: int) -> Iterator[tuple[int, Block, np.ndarray, np.ndarray]]:
    """(name, block, document ids, marks: 1 held out, 2 null id) of each block."""
    for batch in held_until_done(batches):
        for lo, hi, data, offsets in bw.slices(batch.column("text"), BLOCK_BYTES):
            w = bw.find_words(data, offsets, bw.SPACED, lower=True)
            length = np.diff(w.first) + 1
            tokens = np.full(len(w.start) + len(length), _END, np.uint64)
            inner = np.ones(len(tokens), bool)
            inner[np.cumsum(length) - 1] = False
            tokens[inner] = bw.word_hashes(w)
            names, local = np.unique(np.concatenate([tokens, [_START]]), return_inverse=True)
            ids, held = batch.column("id").slice(lo, hi - lo), batch.column("held").slice(lo, hi - lo)
            number = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            marks = held.to_numpy(zero_copy_only=False).astype(np.uint8) + 2 * ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            digest = hashlib.blake2b(digest_size=8)
            for a in (names, local, length, number, marks):
                digest.update(np.ascontiguousarray(a))
            yield int.from_bytes(digest.digest(), "little", signed=True), Block(names, local[:-1], length, busy, shards), number, marks


def _requests(busy, shards: int):
    """Rows (id, text, held) to what each block asks of each shard, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for name, b, _, marks in _blocks(batches, busy.value, shards):
            learn = np.repeat(marks & 1 == 0, b.length)
            counts = [np.bincount(b.tokens[learn], minlength=len(b.names)), np.bincount(b.pair[learn], minlength=len(b.word)),
                      np.bincount(b.triple[learn & (b.triple >= 0)], minlength=len(b.third))]
            rows = [(s, squeeze(m)) for s in range(shards) if (m := b.message(s, counts)) is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in rows], pa.int32()), pa.array([name] * len(rows), pa.int64()), pa.array([m for _, m in rows], pa.binary())],
                names=["shard", "block", "payload"])

    return run


def _block_rows(busy, shards: int):
    """Rows (id, text, held) to one compressed row per block, by which answers are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for name, b, ids, marks in _blocks(batches, busy.value, shards):
            by_count = np.argsort(-np.bincount(b.tokens, minlength=len(b.names)), kind="stable")
            rank = np.empty(len(b.names), np.uint32)
            rank[by_count] = np.arange(len(b.names))
            planes = rank[b.tokens].view(np.uint8).reshape(-1, 4).T
            listed = b.code >= 0
            data = _pack(*map(np.ascontiguousarray, planes), _small(by_count), _small(b.code[listed]), _planes(b.names[~listed]), _small(b.length), ids, marks)
            yield pa.RecordBatch.from_arrays([pa.array([_BLOCK_ROW], pa.int32()), pa.array([name], pa.int64()), pa.array([squeeze(data)], pa.binary())], names=["shard", "block", "payload"])

    return run


def _read_block(data: bytes, busy: Busy, shards: int) -> tuple[Block, np.ndarray, np.ndarray]:
    *planes, by_count, listed, others, length, ids, marks = _unpack(zstandard.ZstdDecompressor().decompress(data))
    names = np.sort(np.concatenate([busy.frequent[listed], _from_planes(others)]))
    rank = np.ascontiguousarray(np.stack(planes, 1)).view("<u4").ravel()
    return Block(names, by_count.astype(np.int64)[rank], length.astype(np.int64), busy, shards), ids.view(np.int64), marks


def _by(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of each value of the sorted key."""
    at, rows = None, []
    for batch in held_until_done(batches):
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            k = row[batch.schema.get_field_index(key)]
            if k != at and rows:
                yield at, rows
                rows = []
            at = k
            rows.append(row)
    if rows:
        yield at, rows


_ANSWER = "kind int, shard int, block long, payload binary, context long, a long, b long"


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys of positive counts, and the sums of these."""
    some = np.flatnonzero(counts)
    order = some[np.argsort(keys[some], kind="stable")]
    k, c = keys[order], counts[order].astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[head], np.add.reduceat(c, head) if len(k) else c


def _joined(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (u.astype(np.uint64) << np.uint64(32)) | v.astype(np.uint64)


class _Shard:
    """The messages of one shard with words numbered alike, the counts of its n-grams, and its trie."""

    def __init__(self, payloads: list[bytes], frequent: np.ndarray):
        unsqueeze = zstandard.ZstdDecompressor().decompress
        asked = [_unpack(unsqueeze(p)) for p in payloads]
        names = [np.concatenate([frequent[x[0]], _from_planes(x[1])]) for x in asked]
        self.vocabulary, inverse = np.unique(np.concatenate(names), return_inverse=True)
        inverse = inverse.astype(np.int32)
        at, self.asked = 0, []
        for x, n in zip(asked, map(len, names), strict=True):
            self.asked.append([inverse[at : at + n][i] for i in x[2:8]] + x[8:])
            at += n
        del inverse, names
        join = lambda k: np.concatenate([x[k] for x in self.asked])
        size = len(self.vocabulary)
        self.counts = np.zeros(size, np.int64)
        np.add.at(self.counts, join(0), join(6).astype(np.int64))
        self.guests2 = np.unique(join(1))
        asked2 = np.concatenate([_joined(self.contexts(x), x[2]) for x in self.asked])
        keys2, sums = _summed(asked2, join(9))
        self.total2, self.kinds2 = self.totals(keys2, sums, size)
        far = np.zeros(size, bool)
        far[self.guests2] = True
        context = (keys2 >> np.uint64(32)).astype(np.int64)
        code2 = eftrie.quantise(np.where(far[context], sums * _UNIT, sums / np.maximum(self.total2 + self.kinds2, 1)[context]))
        self.guests3 = np.unique(np.concatenate([_joined(x[3], x[4]) for x in self.asked]))
        self.pairs = len(keys2)
        nodes = self.pairs + len(self.guests3)
        place = np.searchsorted(keys2, asked2)
        place = np.where(keys2[np.minimum(place, self.pairs - 1)] == asked2, place, -1) if self.pairs else np.full(len(asked2), -1)
        edge = np.cumsum([0, *(len(x[2]) for x in self.asked)])
        below = np.concatenate([self.nodes(x, place[a:b]) for x, a, b in zip(self.asked, edge[:-1], edge[1:], strict=True)])
        del asked2, place
        known = np.flatnonzero(below >= 0)
        keys3, sums = _summed(_joined(below[known], join(5)[known]), join(12)[known])
        del below, known
        self.total3, self.kinds3 = self.totals(keys3, sums, nodes)
        context = (keys3 >> np.uint64(32)).astype(np.int64)
        code3 = eftrie.quantise(np.where(context >= self.pairs, sums * _UNIT, sums / np.maximum(self.total3 + self.kinds3, 1)[context]))
        self.trie = eftrie.Trie([(size, keys2, code2), (nodes, keys3, code3)])
        self.weight2, self.weight3 = (eftrie.quantise(np.where(t > 0, k / np.maximum(t + k, 1), 1.0)) for t, k in ((self.total2, self.kinds2), (self.total3, self.kinds3)))

    @staticmethod
    def contexts(x: list[np.ndarray]) -> np.ndarray:
        """The first word of each pair of a message."""
        return np.concatenate([np.repeat(x[0], x[7]), np.repeat(x[1], x[8])])

    @staticmethod
    def totals(keys: np.ndarray, sums: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        context = (keys >> np.uint64(32)).astype(np.int64)
        total = np.zeros(n, np.int64)
        np.add.at(total, context, sums)
        return total, np.bincount(context, minlength=n)

    def nodes(self, x: list[np.ndarray], place: np.ndarray) -> np.ndarray:
        """The context of each triple of a message, from the places of its pairs; -1: never seen."""
        guest = self.pairs + np.searchsorted(self.guests3, _joined(x[3], x[4]))
        return np.concatenate([np.repeat(place, x[10]), np.repeat(guest, x[11])])

    def answer(self, x: list[np.ndarray]) -> bytes:
        """Counts and weights of a message's own words, codes and weights of its pairs, codes of its triples."""
        place = self.trie.find(0, self.contexts(x), x[2])
        third = self.trie.find(1, self.nodes(x, place), x[5])
        weight = np.where(place >= 0, self.weight3[np.maximum(place, 0)] if len(self.weight3) else 1, 1).astype(np.uint16)
        return _pack(_small(self.counts[x[0]]), self.weight2[x[0]], self.trie.codes(0, place), weight, self.trie.codes(1, third))


def _answer(busy):
    """Requests sorted by shard to answers (kind 0), totals of spread contexts (1) and of words (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _by(batches, "shard"):
            blocks, payloads = [r[1] for r in rows], [r[2] for r in rows]
            rows.clear()
            yield from _answer_shard(number, blocks, payloads, busy.value.frequent)

    return run


def _answer_shard(number: int, blocks: list[int], payloads: list[bytes], frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    if payloads:
        shard = _Shard(payloads, frequent)
        payloads.clear()
        try:
            out: list[tuple] = [(0, number, block, squeeze(shard.answer(x)), None, None, None) for block, x in zip(blocks, shard.asked, strict=True)]
        finally:
            shard.trie.close()
        name = shard.vocabulary
        pairs = _pair_names(name[(shard.guests3 >> np.uint64(32)).astype(np.int64)], name[(shard.guests3 & _LOW).astype(np.int64)])
        nodes = shard.pairs + np.arange(len(pairs))
        for names, total, kinds in ((name[shard.guests2], shard.total2[shard.guests2], shard.kinds2[shard.guests2]), (pairs, shard.total3[nodes], shard.kinds3[nodes])):
            out += [(1, number, None, None, *r) for r in zip(names.view(np.int64).tolist(), total.tolist(), kinds.tolist(), strict=True)]
        out.append((2, number, None, None, None, int(shard.counts.sum()), int((shard.counts > 0).sum())))
        kinds_ = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds_, strict=True)], names=[f.split()[0] for f in _ANSWER.split(", ")])


def _scores(busy, totals, shards: int, n_all: int, n_kinds: int):
    """Block rows and answers, sorted by block and shard, to scores of documents; ``totals`` holds
    c and k of the spread contexts in the order of their list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.maximum(totals.value.sum(axis=1), 1)
        weight = np.where(totals.value[:, 0] > 0, totals.value[:, 1] / mass, 1.0)
        lost = ValueError("the input gave other rows when it was read again")
        for _, rows in _by(batches, "block"):
            own = [r[2] for r in rows if r[0] == _BLOCK_ROW]
            answers = {r[0]: r[2] for r in rows if r[0] != _BLOCK_ROW}
            if not own:
                raise lost
            block, ids, marks = _read_block(own[0], busy.value, shards)
            counts, weight2 = np.zeros(len(block.names), np.int64), np.ones(len(block.names))
            code2, weight3, code3 = np.zeros(len(block.word)), np.ones(len(block.word)), np.zeros(len(block.third))
            for s in range(shards):
                words, p, t = block.part(s)
                if not len(words) and not len(p) and not len(t):
                    continue
                if s not in answers:
                    raise lost
                c, w2, x2, w3, x3 = _unpack(zstandard.ZstdDecompressor().decompress(answers[s]))
                counts[words], weight2[words] = c, eftrie.dequantise(w2)
                code2[p], weight3[p], code3[t] = eftrie.dequantise(x2), eftrie.dequantise(w3), eftrie.dequantise(x3)
            hot = np.flatnonzero(block.spot >= 0)
            weight2[hot] = weight[block.spot[hot]]
            hot = np.flatnonzero(block.pair_spot >= 0)
            weight3[hot] = weight[block.pair_spot[hot]]
            hot = np.flatnonzero(block.guest2)
            code2[hot] /= _UNIT * mass[block.spot[block.context[hot]]]
            hot = np.flatnonzero(block.guest3)
            code3[hot] /= _UNIT * mass[block.pair_spot[block.below[hot]]]
            base = np.log10((counts + 1) / (n_all + n_kinds + 1))
            spare = DISCOUNT * n_kinds / n_all / (n_kinds + 1) if n_all else 1.0
            single = np.where(counts > 0, (counts - DISCOUNT) / max(n_all, 1), 0.0) + spare
            two = (code2 + weight2[block.context] * single[block.word])[block.pair]
            later = np.flatnonzero(block.triple >= 0)
            which = block.triple[later]
            two[later] = code3[which] + weight3[block.below[which]] * two[later]
            first = np.cumsum(block.length) - block.length
            for _ in own:  # blocks of one name are equal
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64(), mask=marks & 2 > 0), pa.array(marks & 1 > 0), pa.array(block.length), pa.array(np.add.reduceat((counts > 0)[block.tokens].astype(np.int64), first)),
                     pa.array(np.add.reduceat(base[block.tokens], first)), pa.array(np.add.reduceat(np.log10(two), first))],
                    names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each frequent context occurs in some texts (start marks included), and under 0 all tokens."""
    for batch in held_until_done(batches):
        for _, _, data, offsets in bw.slices(batch.column("text"), BLOCK_BYTES):
            w = bw.find_words(data, offsets, bw.SPACED, lower=True)
            h, doc = bw.word_hashes(w), w.doc
            starts = h[w.first[:-1][np.diff(w.first) > 0]]
            same = doc[1:] == doc[:-1]
            pairs = np.concatenate([_pair_names(h[:-1][same], h[1:][same]), _pair_names(np.full(len(starts), _START), starts)])
            total = len(h) + len(offsets) - 1
            out = [(0, total), (int(_START), len(offsets) - 1)]
            for names in (h, pairs):
                x, n = np.unique(names, return_counts=True)
                often = (n * 20_000 > total) | ((n > 1) & (names is h))
                out += zip(x[often].view(np.int64).tolist(), n[often].tolist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([n for _, n in out], pa.int64())], names=["word", "n"])


def busy_contexts(docs: DataFrame, partitions: int) -> tuple[Busy, int]:
    """Contexts with over half a shard's share in a fiftieth of the texts, four for each shard at most, and
    the number of shards: of SHARD_TOKENS, or two for each partition if that makes more. Besides, the
    ``_FREQUENT`` most frequent words, which only save room in messages."""
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(_SAMPLE)) == 0).select("text")
    sums = written(some.mapInArrow(_tally, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "tally")
    total = sums.where("word = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(2, 2 * partitions, -(-total * _SAMPLE // SHARD_TOKENS))
    top = sums.where((F.col("word") != 0) & (2 * shards * F.col("n") > total)).orderBy(F.desc("n"), "word").limit(4 * shards).collect()
    often = sums.where("word not in (0, " + str(int(_START)) + ")").orderBy(F.desc("n"), "word").limit(_FREQUENT).collect()
    return Busy([r.word % (1 << 64) for r in top], [max(1, min(shards - 1, -(-4 * r.n * shards // total))) for r in top], [r.word % (1 << 64) for r in often]), shards


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``,
    learned from the rows that are not ``held_out``; ids are longs."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    found, shards = busy_contexts(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    busy = sc.broadcast(found)
    asked = rows.mapInArrow(_requests(busy, shards), _ROW).repartitionById(shards, "shard").sortWithinPartitions("shard", "block")
    answers = written(asked.mapInArrow(_answer(busy), _ANSWER), "answers")
    del asked
    sums = answers.where("kind = 2").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("v")).first()
    totals = np.zeros((len(found.names), 2), np.int64)
    for r in answers.where("kind = 1").groupBy("context").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect():
        totals[found.find(np.array([r.context % (1 << 64)], np.uint64))[0]] = r.a, r.b
    back = rows.mapInArrow(_block_rows(busy, shards), _ROW).unionByName(answers.where("kind = 0").select("shard", "block", "payload"))
    dealt = back.repartition(shards, "block").sortWithinPartitions("block", "shard")
    out = dealt.mapInArrow(_scores(busy, sc.broadcast(totals), shards, sums.n, sums.v), "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(sums.n).cast("long").alias("train_tokens"), "base_score", "score")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return score(docs, held)

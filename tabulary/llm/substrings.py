"""Substring deduplication by seed and extend over winnowed anchors.

Texts are taken once each: copies collapse by content first. In every stretch of
``WINNOW`` consecutive runs of ``ANCHOR`` words the run with the least hash is an
anchor, so each stretch of ``length`` = ANCHOR + WINNOW - 1 words owns one anchor,
and equal stretches own equal anchors at equal places. That makes the join exact:

1. anchors that occur once anywhere are dropped after a pre-aggregated count;
2. occurrences of the other anchors are extended both ways: an occurrence
   brings along the hash of each stretch that owns it, in order;
3. occurrences of an anchor meet; a stretch whose hash meets another one is a
   repeat, and neighbouring repeats join into maximal ones.

No pairs are made, and words are not compared one by one: the hashes of the stretches
around a shared anchor take the place of a word-by-word extension, and a run of
neighbouring stretches that all have their like is a maximal repeat. An anchor of n
occurrences, in one text or many, if more than ``CROWD``, is split over the square root of n salts. Within a
salt, a stretch that meets its like is settled; one that does not is sent on to a second
round by its own hash, with one witness per hash of each salt. So both rounds hold about
the square root of n rows of any anchor or stretch.

Repeats are judged on the input. Defined results: null, empty and shorter texts
have no repeats; copies of a text of at least ``length`` words repeat each other
in full; a very long text is worked on whole by one task; rows with equal or null ids stay
separate; an empty table gives none. Columns other than the id and the text are not read,
so their names cannot clash. Texts are told apart by hashes of 64 and 31 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.llm import bytewords as bw
from tabulary.llm.arrowmap import held_until_done, written

LENGTH = 35
ANCHOR = 12
CROWD = 256
_KEY = ["t", "nb"]


def _anchors(w: bw.Words, h: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch starts, place of the anchor each owns, hashes of all runs)."""
    runs = bw.window_hashes(h, anchor)
    span = length - anchor + 1
    if len(h) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), runs
    doc = w.doc
    start = np.flatnonzero(doc[: len(h) - length + 1] == doc[length - 1 :])
    place = np.empty(len(start), np.int64)
    views = sliding_window_view(runs, span)
    for lo in range(0, len(start), 1 << 16):  # keeps the compared copies small
        s = start[lo : lo + (1 << 16)]
        place[lo : lo + len(s)] = s + views[s].argmin(axis=1)
    return start, place, runs


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64), pa.int64())


def _seed(length: int, anchor: int):
    """Rows (t, nb, text) to anchors (a, t, at), at holding the text's second hash and the anchor's word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held_until_done(batches):
            t, nb = batch.column("t").to_numpy(), batch.column("nb").to_numpy()
            for lo, _, data, offsets in bw.slices(batch.column("text")):
                w = bw.find_words(data, offsets, bw.SPACED)
                _, place, runs = _anchors(w, bw.word_hashes(w), length, anchor)
                place = np.unique(place)
                doc = w.doc[place]
                yield pa.RecordBatch.from_arrays(
                    [_as_long(runs[place]), pa.array(t[lo + doc]), pa.array(nb[lo + doc] << 32 | (place - w.first[doc]))], names=["a", "t", "at"])

    return run


def _extend(length: int, anchor: int):
    """Rows (t, nb, text, places) to (a, t, at, first, hashes): for each anchor of places that
    owns stretches, the word where the first of them starts and the hash of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held_until_done(batches):
            t, nb = batch.column("t").to_numpy(), batch.column("nb").to_numpy()
            places = batch.column("places")
            for lo, hi, data, offsets in bw.slices(batch.column("text")):
                w = bw.find_words(data, offsets, bw.SPACED)
                h = bw.word_hashes(w)
                start, place, runs = _anchors(w, h, length, anchor)
                if not len(start):
                    continue
                some = places.slice(lo, hi - lo)
                n = np.diff(some.offsets.to_numpy())
                wanted = np.zeros(len(h) + 1, bool)
                wanted[np.repeat(w.first[:-1], n) + some.flatten().to_numpy()] = True
                whole = bw.window_hashes(h, length)[start]
                head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                end = np.append(head[1:], len(start))
                own = wanted[place[head]]
                head, end = head[own], end[own]
                at, doc = place[head], w.doc[start[head]]
                size = end - head
                index = np.repeat(head - (np.cumsum(size) - size), size) + np.arange(size.sum())
                blob = np.ascontiguousarray(whole[index]).view(np.uint8)
                lists = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size * 8)]).astype(np.int32)), pa.py_buffer(blob)])
                yield pa.RecordBatch.from_arrays(
                    [_as_long(runs[at]), pa.array(t[lo + doc]), pa.array(nb[lo + doc]), pa.array((start[head] - w.first[doc]).astype(np.int32)), lists],
                    names=["a", "t", "nb", "first", "hashes"])

    return run


_MET = "t long, nb long, first int, n int, hash long"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, salt, salted, t, nb, first, hashes), sorted by anchor and salt, to settled repeats (t, nb, first,
    n, null) and, from salted anchors, unsettled stretches and witnesses (.., 0, hash)."""
    for part in _whole_runs(batches, ("a", "salt")):
        size = pc.binary_length(part.column("hashes")).to_numpy().astype(np.int64) // 8
        hashes = np.frombuffer(b"".join(part.column("hashes").to_pylist()), np.uint64)
        row = np.repeat(np.arange(len(size)), size)
        start = part.column("first").to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        salted = part.column("salted").to_numpy(zero_copy_only=False)[row]
        order = np.argsort(hashes, kind="stable")
        s = hashes[order]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        group = np.cumsum(new) - 1
        count = np.bincount(group)
        many = np.zeros(len(s), bool)
        many[order] = count[group] > 1
        lead = np.zeros(len(s), bool)
        lead[order] = new
        yield from _settled(part, row, start, many)
        open_ = np.flatnonzero(salted & (~many | lead))
        if len(open_):
            r = row[open_]
            single = ~many[open_]
            yield pa.RecordBatch.from_arrays(
                [part.column("t").take(pa.array(r)), part.column("nb").take(pa.array(r)), pa.array(start[open_].astype(np.int32)),
                 pa.array(np.where(single, 1, 0).astype(np.int32)), _as_long(hashes[open_])], names=["t", "nb", "first", "n", "hash"])


def _settled(part, row: np.ndarray, start: np.ndarray, many: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(many)
    if not len(at):
        return
    head = np.concatenate([[True], (row[at][1:] != row[at][:-1]) | (start[at][1:] != start[at][:-1] + 1)])
    first = at[head]
    n = np.diff(np.append(np.flatnonzero(head), len(at)))
    r = pa.array(row[first])
    yield pa.RecordBatch.from_arrays(
        [part.column("t").take(r), part.column("nb").take(r), pa.array(start[first].astype(np.int32)), pa.array(n.astype(np.int32)),
         pa.nulls(len(n), pa.int64())], names=["t", "nb", "first", "n", "hash"])


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Batches of about ``rows`` rows, cut between values of the sorted keys; each row is copied once."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in held_until_done(batches):
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for k in columns:
            new[1:] |= k[1:] != k[:-1]
        new[0] = last is not None and any(k[0] != x for k, x in zip(columns, last, strict=True))
        last = [k[-1] for k in columns]
        if sum(b.num_rows for b in held) + batch.num_rows >= rows and new.any():
            cut = int(np.flatnonzero(new)[-1])
            if held or cut:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unsettled stretches, sorted by hash, to those whose hash another salt has seen too."""
    for part in _whole_runs(batches, ("hash",)):
        h = part.column("hash").to_numpy()
        new = np.concatenate([[True], h[1:] != h[:-1]])
        count = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
        keep = pa.array((count > 1) & (part.column("n").to_numpy() == 1))
        yield part.filter(keep).select(["t", "nb", "first", "n", "hash"])


def _cut(length: int):
    """Rows (t, nb, copies, text, spans) to word counts, removed words and the digest of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held_until_done(batches):
            t, nb, copies = (batch.column(c).to_numpy() for c in ("t", "nb", "copies"))
            for lo, hi, data, offsets in bw.slices(batch.column("text")):
                w = bw.find_words(data, offsets, bw.SPACED)
                words = np.diff(w.first)
                edge = np.zeros(len(w.start) + 1, np.int64)
                twice = np.flatnonzero((copies[lo:hi] > 1) & (words >= length))
                np.add.at(edge, w.first[twice], 1)
                np.add.at(edge, w.first[twice + 1], -1)
                spans = batch.column("spans").slice(lo, hi - lo)
                n = np.diff(spans.offsets.to_numpy())
                flat = spans.flatten()
                begin = np.repeat(w.first[:-1], n) + flat.field("first").to_numpy()
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + flat.field("n").to_numpy() + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed, digests, spans_out = [], [], []
                raw = data.tobytes()
                for d in range(hi - lo):
                    a, b = int(w.first[d]), int(w.first[d + 1])
                    bad = gone[a:b]
                    k = int(bad.sum())
                    if k == 0:
                        kept = raw[offsets[d] : offsets[d + 1]].split()
                    elif k == b - a:
                        kept = []
                    else:
                        good = np.flatnonzero(~bad) + a
                        kept = [raw[x:y] for x, y in zip(w.start[good].tolist(), w.end[good].tolist(), strict=True)]
                    flips = np.flatnonzero(np.diff(bad.astype(np.int8), prepend=0, append=0))
                    removed.append(k)
                    spans_out.append(flips.tolist())
                    digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t[lo:hi]), pa.array(nb[lo:hi]), pa.array(words.astype(np.int64)), pa.array(removed, pa.int64()),
                     pa.array(digests, pa.string()), pa.array(spans_out, pa.list_(pa.int32()))],
                    names=["t", "nb", "n_words", "n_removed", "kept_sha256", "repeats"])

    return run


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, crowd: int = CROWD) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256, repeats) of each row of ``docs``.

    ``repeats`` lists the maximal runs of repeated words (begin, end, begin, end ...)
    and kept_sha256 digests the words outside them, joined by one space.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", F.xxhash64("text").alias("t"), F.crc32("text").bitwiseAND(F.lit((1 << 31) - 1)).alias("nb"))
    texts = keyed.groupBy(*_KEY).agg(F.min("text").alias("text"), F.count("*").alias("copies"))
    seeds = texts.select(*_KEY, "text").mapInArrow(_seed(length, anchor), "a long, t long, at long")
    # Counted under another key than the join's: so both sides of the join are exchanges, and a
    # partition that a frequent anchor makes large can be split.
    known = seeds.groupBy(F.bitwise_not("a").alias("k")).agg(F.count("*").alias("occurrences")).where("occurrences > 1")
    known = known.select(F.bitwise_not("k").alias("a"), "occurrences")
    crowded = known.where(F.col("occurrences") > crowd).select("a", F.ceil(F.sqrt("occurrences")).cast("int").alias("salts"))
    places = seeds.join(known.select("a"), "a", "left_semi").select("t", F.shiftright("at", 32).alias("nb"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("place"))
    places = places.groupBy(*_KEY).agg(F.collect_list("place").alias("places"))
    wide = texts.select(*_KEY, "text").join(places, _KEY).mapInArrow(_extend(length, anchor), "a long, t long, nb long, first int, hashes binary")
    salted = wide.join(crowded, "a", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("t", "nb", "first"), F.col("salts")), F.lit(0)).cast("int"))
    salted = salted.select("a", "salt", F.col("salts").isNotNull().alias("salted"), "t", "nb", "first", "hashes")
    met = salted.repartition("a", "salt").sortWithinPartitions("a", "salt").mapInArrow(_meet, _MET)
    more = met.where("hash is not null").repartition("hash").sortWithinPartitions("hash").mapInArrow(_second, _MET)
    found = met.where("hash is null").unionByName(more).groupBy(*_KEY).agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    found = written(found, "spans")
    full = texts.join(found, _KEY, "left").select(*_KEY, "copies", "text", F.coalesce("spans", F.array().cast("array<struct<first:int,n:int>>")).alias("spans"))
    done = full.mapInArrow(_cut(length), "t long, nb long, n_words long, n_removed long, kept_sha256 string, repeats array<int>")
    return keyed.select("id", *_KEY).join(done, _KEY).select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", "repeats")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")

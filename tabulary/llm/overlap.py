"""Groups of texts by the words they share: Jaccard similarity of five-word shingles.

A text's shingles are all runs of ``WIDTH`` words (A-Z lower-cased, cut at ASCII white
space), or the whole text if it is shorter. Texts of which at least ``SHARE`` of their
joint shingles are common are linked. Candidates agree in all ``ROWS`` minima of one of
``BANDS`` bands of MinHash; each is checked on the full shingle sets. A pair at exactly
0.8 is no candidate with a probability of 3e-6, one at 0.9 of 4e-12.

Keys whose texts are all in one group by now are left out of every round. In two rounds
each text is compared with one other: of the least texts of its keys the one that it meets
most often. In the keys that still hold several groups, whole texts then meet in one task,
which compares those of different groups on the spot and gives one link for each two
groups that it joins, never all pairs. A key of more than ``CROWD`` texts is dealt out to
tasks in blocks, each block meeting each other one, so that no task holds more than two.

Defined results: texts without words have no shingles and are linked to none; texts are
told apart by a 64-bit hash, shingles by another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulary.llm import bytewords as bw
from tabulary.llm.arrowmap import add_columns, held_until_done, written
from tabulary.llm.components import components
from tabulary.llm.shingles import word_sets

WIDTH = 5
SHARE = (4, 5)
BANDS, ROWS = 24, 4
_XOR, _FACTOR = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64, endpoint=False)
_FACTOR |= np.uint64(1)
#: Texts of one key that meet in one task, and the equal minima of two texts below which they are not compared:
#: two texts at exactly 0.8 have fewer with a probability of 1e-8.
CROWD, MATCHES = 1024, 54
_SLICE = 1 << 18


def _distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, in order of their hash mixed with the text's number, and where they begin."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(first) - 1))])


def minima(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, BANDS * ROWS) least values of each text's shingles; zeros without shingles."""
    some = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, BANDS * ROWS), np.uint64)
    if len(some):
        for k in range(BANDS * ROWS):
            out[some, k] = np.minimum.reduceat((h ^ _XOR[k]) * _FACTOR[k], first[some])
    return out


def bands(least: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys of the minima."""
    keys = np.zeros((len(least), BANDS), np.uint64)
    for k in range(ROWS):
        keys = bw.mix(keys * np.uint64(31) + least[:, k::ROWS])
    return bw.mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64))


BANDS_DDL = "n_shingles int, bands array<long>"


def bands_of(column: pa.Array) -> dict:
    """n_shingles and the keys of the bands of each text."""
    sizes, keys = [np.zeros(0, np.int64)], [np.zeros((0, BANDS), np.uint64)]
    for _, _, data, offsets in bw.slices(column, _SLICE):
        h, first = _distinct(*word_sets(data, offsets, WIDTH))
        sizes.append(np.diff(first))
        keys.append(bands(minima(h, first)))
    n = np.concatenate(sizes)
    has = n > 0
    at = np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32)
    flat = np.concatenate(keys)[has].ravel().view(np.int64)
    return {"n_shingles": pa.array(n.astype(np.int32)), "bands": pa.ListArray.from_arrays(pa.array(at), pa.array(flat))}


def _sets(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct shingles of each text, and their minima."""
    sets, least = [], [np.zeros((0, BANDS * ROWS), np.uint64)]
    for _, _, data, offsets in bw.slices(column, _SLICE):
        h, first = _distinct(*word_sets(data, offsets, WIDTH))
        sets += np.split(h, first[1:-1])
        least.append(minima(h, first))
    return sets, np.concatenate(least)


def _are_alike(x: np.ndarray, y: np.ndarray) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common > 0 and common * SHARE[1] >= (len(x) + len(y) - common) * SHARE[0]


def _compared(batch: pa.RecordBatch) -> dict:
    """Whether text_a and text_b of each row share enough shingles."""
    a, b = (_sets(batch.column(c))[0] for c in ("text_a", "text_b"))
    return {"alike": pa.array([_are_alike(x, y) for x, y in zip(a, b, strict=True)], pa.bool_())}


def _checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (u, v) between the groups of those ``pairs`` whose texts are alike."""
    pairs = written(pairs, "pairs")
    for side in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("text_hash").alias(side), F.col("text").alias(f"text_{side}")), side)
    return add_columns(pairs.select("u", "v", "text_a", "text_b"), "alike boolean", _compared, drop=("text_a", "text_b")).where("alike").select("u", "v")


def _bucket_links(group: np.ndarray, half: np.ndarray, texts: pa.Array) -> list[tuple[int, int]]:
    """Links between groups of the texts of one key; where both halves are there, only texts of different halves meet."""
    sets, least = _sets(texts)
    size = np.array([len(x) for x in sets])
    short = least.astype(np.uint32)
    names, label = np.unique(group, return_inverse=True)
    both, out = len(np.unique(half)) > 1, []
    for i in range(len(sets)):
        near = (label[i + 1 :] != label[i]) & (np.minimum(size[i + 1 :], size[i]) * SHARE[1] >= np.maximum(size[i + 1 :], size[i]) * SHARE[0])
        if both:
            near &= half[i + 1 :] != half[i]
        j = np.flatnonzero(near) + i + 1
        j = j[(short[j] == short[i]).sum(axis=1) >= MATCHES] if len(j) else j
        for k in j.tolist():
            if label[k] != label[i] and _are_alike(sets[i], sets[k]):
                out.append((int(names[label[i]]), int(names[label[k]])))
                label[label == label[k]] = label[i]
    return out


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, half, group, text), sorted by the first three, to links (u, v)."""
    held: list[pa.RecordBatch] = []

    def links() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        found = _bucket_links(t.column("group").to_numpy(), t.column("half").to_numpy(), t.column("text").combine_chunks())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    at = None
    for batch in held_until_done(batches):
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy() for k in range(3)]
        edge = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0), [True]]))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            here = tuple(int(k[a]) for k in keys)
            if here != at and held:
                yield links()
            at = here
            held.append(batch.slice(a, b - a))
    if held:
        yield links()


def _met(keyed: DataFrame, texts: DataFrame, crowd: int) -> DataFrame:
    """Edges (u, v) between groups with alike texts among those of one key."""
    # Only crowded keys are looked up: they are few, so that the rows need not be moved for it.
    crowded = keyed.groupBy("key").agg(F.ceil(F.count("*") / crowd).cast("int").alias("blocks")).where("blocks > 1")
    rows = keyed.join(written(crowded, "crowded"), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64(F.lit(7), "text_hash"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("key", "group", "text_hash", "own", other)
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("half"), "group", "text_hash")
    # A block that meets itself must not be told apart from one that meets another.
    rows = rows.withColumn("half", F.when(F.col("i") == F.col("j"), 0).otherwise(F.col("half")))
    whole = rows.join(texts, "text_hash").select("key", "i", "j", "half", "group", "text")
    return whole.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_meet, "u long, v long")


def joined_groups(texts: DataFrame, rows: DataFrame, crowd: int = CROWD) -> list[DataFrame]:
    """Maps (node, root) that join groups with alike texts, to be applied in turn.

    ``texts`` has text_hash and text; ``rows`` has text_hash, group (a long), n_shingles and
    bands. Only texts that share a key with another group are moved.
    """
    keyed = rows.select("group", "text_hash", "n_shingles", F.explode("bands").alias("key"))
    maps: list[DataFrame] = []
    for turn in range(3):
        several = keyed.groupBy("key").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x <> y").select("key")
        keyed = written(keyed.join(several, "key", "left_semi").distinct(), "keys")
        if turn == 0:
            texts = written(texts.join(keyed.select("text_hash").distinct(), "text_hash", "left_semi").dropDuplicates(["text_hash"]), "candidates", compression="zstd")
        if turn == 2:
            maps.append(written(components(_met(keyed, texts, crowd)), "joined"))
            break
        least = keyed.groupBy("key").agg(F.min(F.struct("text_hash", "group", "n_shingles")).alias("o"))
        met = keyed.join(least.select("key", *(F.col(f"o.{c}").alias(f"o_{c}") for c in ("group", "text_hash", "n_shingles"))), "key")
        met = met.where((F.col("group") != F.col("o_group")) & (F.least("n_shingles", "o_n_shingles") * SHARE[1] >= F.greatest("n_shingles", "o_n_shingles") * SHARE[0]))
        met = met.groupBy(F.col("text_hash").alias("a"), F.col("o_text_hash").alias("b"), F.col("group").alias("u"), F.col("o_group").alias("v")).agg(F.count("*").alias("n"))
        pairs = met.groupBy("a").agg(F.max(F.struct("n", "b", "u", "v")).alias("p")).select("a", "p.b", "p.u", "p.v")
        found = written(components(_checked(pairs, texts)), "joined")
        maps.append(found)
        keyed = keyed.join(found, F.col("group") == F.col("node"), "left").select("key", F.coalesce("root", "group").alias("group"), "text_hash", "n_shingles")
    return maps

"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 fingerprint bits i carries a nonzero vector m(i) of radius + 1
bits. For every nonzero v of as many bits, the mask of v keeps the bits i with
an odd number of common ones in m(i) and v. Fingerprints that differ in
``radius`` bits or fewer agree under at least one mask, since the vectors of
those bits leave some v orthogonal to them all: the 15 tables for radius 3 miss
no pair.

Copies collapse into one fingerprint before any table is built. Buckets are counted
first. One of at most ``CROWD`` fingerprints is compared inside its task, which
keeps only one link per fingerprint (to the least of its group), never all
pairs. The members of a larger bucket never meet in one task: they are dealt out at
once by masks over the bits that the bucket leaves free. Then at most 16 bits are free,
so a bucket has at most 65,536 members whatever the input, and is linked inside its
task by looking up each member's neighbours. So no pair is lost and no task gathers more.

Defined results: a null or empty text has no words and fingerprint zero, and is
linked like any other; very long texts are read whole, by the task that holds them;
rows with a null id get the group's least id, or null if the group has none; repeated
rows are copies of one another; an empty table gives none. Columns other than the id and
the text are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.llm import bytewords as bw
from tabulary.llm.arrowmap import add_columns, apart, held_until_done, written
from tabulary.llm.components import components
from tabulary.llm.overlap import BANDS_DDL, bands_of, joined_groups
from tabulary.llm.shingles import shingle_hashes

RADIUS = 3
_PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64())])
CROWD = 2048
#: Bytes of texts, and hashes, that are worked on at once: small enough for the caches.
_SLICE, _HASHES = 1 << 18, 1 << 16


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int = 3) -> np.ndarray:
    """The SimHash of each of a slice's texts over its word shingles, as unsigned longs."""
    h, first = shingle_hashes(data, offsets, width)
    n = np.diff(first)
    ones = np.zeros((len(n), 64), np.int64)
    for at in range(0, len(h), _HASHES):
        end = min(at + _HASHES, len(h))
        lo, hi = int(np.searchsorted(first, at, side="right")) - 1, int(np.searchsorted(first, end, side="left"))
        some = np.flatnonzero(n[lo:hi]) + lo
        bits = np.unpackbits(h[at:end].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[some] += np.add.reduceat(bits, np.maximum(first[some] - at, 0), axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def prints_of(column: pa.Array, width: int = 3) -> pa.Array:
    """The SimHash of each text of a column, as (signed) longs."""
    found = [fingerprints(data, offsets, width) for _, _, data, offsets in bw.slices(column, _SLICE)]
    return pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))


def covering_masks(radius: int = RADIUS, within: int = (1 << 64) - 1) -> list[int]:
    """Masks over the bits of ``within``; any ``radius`` of those bits are outside one mask."""
    size = (1 << (radius + 1)) - 1
    bits = [i for i in range(64) if within >> i & 1]
    return [sum(1 << b for k, b in enumerate(bits) if ((k % size + 1) & v).bit_count() & 1) for v in range(1, size + 1)]


def _tables(radius: int, mask: int = 0) -> list[int]:
    """The masks below ``mask``, each with all of its bits."""
    return [mask | more for more in covering_masks(radius, (1 << 64) - 1 & ~mask)]


def _links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """For each fingerprint of a bucket that has links inside it, one link to its group's least.

    ``fps`` are sorted and distinct. Many of them are not compared in pairs: each
    looks up those that differ from it in ``radius`` of the bucket's free bits.
    """
    x = np.sort(fps.view(np.uint64))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if len(x) <= CROWD:
        for i in range(len(x) - 1):
            near = np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= radius) + i + 1
            found.append((np.full(len(near), i), near))
    else:
        free = int(np.bitwise_or.reduce(x ^ x[0]))
        bits = [1 << b for b in range(64) if free >> b & 1]
        flips = [sum(c) for k in range(1, radius + 1) for c in combinations(bits, k)]
        for flip in flips:
            other = x ^ np.uint64(flip)
            at = np.minimum(np.searchsorted(x, other), len(x) - 1)
            hit = np.flatnonzero((x[at] == other) & (at > np.arange(len(x))))
            found.append((hit, at[hit]))
    label = np.arange(len(x))
    changed = True
    while changed:
        before = label.copy()
        for a, b in found:
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
        label = label[label]
        changed = bool((before != label).any())
    return [(int(v), int(u)) for v, u in zip(x.view(np.int64), x[label].view(np.int64), strict=True) if u != v]


def _bucket_scan(radius: int):
    """Arrow mapper over rows (tab, key, fp) sorted by table and key to links (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at = None
        out: list[tuple[int, int]] = []

        def close() -> None:
            if sum(map(len, held)) > 1:
                out.extend((a, b) for b, a in _links(np.unique(np.concatenate(held)), radius))
            held.clear()

        for batch in held_until_done(batches):
            tab, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(tab):
                continue
            edge = np.flatnonzero(np.concatenate([[True], (tab[1:] != tab[:-1]) | (key[1:] != key[:-1])]))
            size = np.diff(np.append(edge, len(tab)))
            inner = (size == 1) & (edge > 0) & (edge + size < len(tab))
            for a, n in zip(edge[~inner].tolist(), size[~inner].tolist(), strict=True):
                if at != (tab[a], key[a]):
                    close()
                    at = (tab[a], key[a])
                held.append(fp[a : a + n])
            if len(out) > 50_000:
                yield pa.RecordBatch.from_pylist([{"u": u, "v": v} for u, v in out], _PAIRS)
                out.clear()
        close()
        yield pa.RecordBatch.from_pylist([{"u": u, "v": v} for u, v in out], _PAIRS)

    return run


def _masks(masks: list[int]) -> Column:
    return F.array(*(F.lit(_signed(m)) for m in masks))


def _keyed(rows: DataFrame, tables: Column, above: Column) -> DataFrame:
    """(tab, key, fp) of each row (fp) and table: its number below table ``above``, and the bits that it keeps."""
    each = rows.select("fp", above.alias("above"), F.posexplode(tables).alias("i", "mask"))
    return each.select((F.col("above") * 1000 + F.col("i")).alias("tab"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def _linked(keyed: DataFrame, radius: int) -> DataFrame:
    dealt = keyed.repartition(F.col("tab"), F.col("key")).sortWithinPartitions("tab", "key")
    return dealt.mapInArrow(_bucket_scan(radius), "u long, v long")


def links(nodes: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) that connect just the distinct ``fp`` of ``nodes`` which chains of
    pairs within ``radius`` bits connect. Two rounds of masks leave at most 16 bits free
    for radius 3 and less."""
    if radius > RADIUS:
        raise ValueError(f"masks are laid out for a radius of {RADIUS} at most")
    first = _tables(radius)
    keyed = _keyed(nodes.select("fp"), _masks(first), F.lit(0))
    crowded = written(keyed.groupBy("tab", "key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("tab", "key"), "crowded")
    if crowded.isEmpty():
        return written(_linked(keyed, radius), "links")
    small = keyed.join(crowded, ["tab", "key"], "left_anti")
    below = F.array(*(_masks(_tables(radius, m)) for m in first))
    members = _keyed(keyed.join(crowded, ["tab", "key"], "left_semi"), F.get(below, F.col("tab")), F.col("tab"))
    return written(_linked(small, radius).unionByName(_linked(members, radius)), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, crowd: int = CROWD,
                    alike: bool = False) -> DataFrame:
    """(id_col, text_hash, fp, root, component_id): the fingerprint of each row, the least
    fingerprint linked to it, and the least id of that group. With ``alike``, texts that
    share their words (``overlap``) are linked besides."""
    base = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))

    def make(batch: pa.RecordBatch) -> dict:
        column = batch.column(batch.schema.get_field_index("text"))
        return {"fp": prints_of(column)} | (bands_of(column) if alike else {})

    prints = written(add_columns(base, "fp long" + f", {BANDS_DDL}" * alike, make, drop=("text",)), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = components(links(nodes, radius, crowd))
    nodes = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    nodes = written(nodes, "roots")
    if alike:
        rows = prints.join(nodes, "fp").select("text_hash", F.col("root").alias("group"), "n_shingles", "bands").dropDuplicates(["text_hash"])
        for found in joined_groups(base.select("text_hash", "text"), rows):
            nodes = nodes.join(found.withColumnRenamed("root", "to"), F.col("root") == F.col("node"), "left").select("fp", "least", F.coalesce("to", "root").alias("root"))
        nodes = written(nodes, "roots")
    groups = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(nodes.join(groups, "root").select("fp", "root", "component_id"), "fp")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates the document with the least id.

    Near-duplicates are op2's, and texts with a five-word similarity of 0.8 or more.
    Rows go to their group's choice in one shuffle; only choices of which the input has
    several equal rows are told apart in another.
    """
    found = near_duplicates(docs, alike=True).groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "copies"))
    chosen = found.groupBy("root").agg(first.alias("k")).select(F.col("k.doc_id").alias("kept_id"), F.col("k.text_hash").alias("kept_hash"), F.col("k.copies").alias("kept_copies"))
    keep = written(chosen, "kept")
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash"))

    def kept(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("text_hash", F.xxhash64("text"))
        single = rows.join(keep.where("kept_copies = 1"), same, "left_semi")
        several = rows.join(keep.where("kept_copies > 1"), same, "left_semi")
        return single.unionByName(several.dropDuplicates(["doc_id", "text_hash"]))

    return apart(docs, ("text_hash", "kept_id", "kept_hash", "kept_copies"), kept)

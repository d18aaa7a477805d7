"""Packing of token ids into windows by non-negative least squares over the histogram of lengths.

A document's ids are cut into whole windows and a tail. Tails are packed by their lengths
alone: all combinations of two or three lengths that fill a window exactly (``combinations``)
are the columns of a counting matrix A, and repeat counts x >= 0 that minimise |A x - h|
against the histogram h are found by coordinate descent (``repeat_counts``), rounded, and
taken as far as there are tails. What is left is packed greedily, longest first with the
longest that still fits, on counts, so a step packs all tails of equal lengths. Then the
least filled of the greedy windows are taken apart and their ids, cut freely, fill the
gaps of the others; what still remains, less than a window, goes to sequences whose lengths
are powers of two. Only gaps of less than a 128th of the window stay: no text is cut into
crumbs for them, and they are the only padding.

Only counts pass through the driver: the histogram has a row for each length below the
window, and the plan at most a few slots for each combination, whatever the corpus. Each
document finds its place by arithmetic: its number among all tails of its length, from
counts by block and length, names its slot. Tokens are stored once, in ``ids``; the blocks'
first numbers meet them in one join.

Defined results: a null or empty text has the end id only; an empty table gives no pieces;
repeated rows and rows with equal or null ids are documents of their own; very long texts
give whole windows and one tail; equal lengths, however many, are numbered within blocks, so
no task holds all of one length. Sequences are numbered without gaps: whole windows first.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulary.llm import bytepairs
from tabulary.llm.arrowmap import PIECE_BYTES, held_until_done, written

WINDOW = 2048
END_ID = 1
#: Most rounds of coordinate descent; fewer change how many documents are cut, not whether all are packed.
ROUNDS = 300
#: Gaps of up to the window over this stay open.
CRUMB = 128
_CANDIDATES = 4096
_TAIL_SHIFT = 44


def combinations(histogram: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths, shortest first, that add up to ``window``; the first of two is 0. All occur in the histogram."""
    have = histogram > 0
    have[0] = False
    lengths = np.flatnonzero(have)
    found = []
    for first in [0, *lengths[lengths <= window // 3].tolist()]:
        second = lengths[(lengths >= first) & (2 * lengths <= window - first)]
        second = second[have[window - first - second]]
        found.append(np.stack([np.full(len(second), first), second, window - first - second], 1))
    return np.concatenate(found)


def repeat_counts(histogram: np.ndarray, mixes: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 with small |A x - histogram|, A counting the lengths of each of ``mixes``.

    A round moves each of a set of combinations that share no length to its own minimum,
    those first that lower the square most, so that few counts are non-zero.
    """
    a, b, c = mixes.T
    same = 2 * ((a == b).astype(int) + (b == c) + (a == c))
    norm = np.where(a == 0, 2, 3) + same.astype(np.float64)
    rest, x = histogram.astype(np.float64), np.zeros(len(mixes))
    for _ in range(rounds if len(mixes) else 0):
        rest[0] = 0
        slope = rest[a] + rest[b] + rest[c]
        move = np.maximum(slope / norm, -x)
        gain = (slope - norm * move / 2) * move
        best = np.argpartition(-gain, _CANDIDATES)[:_CANDIDATES] if len(gain) > _CANDIDATES else np.arange(len(gain))
        best = best[np.argsort(-gain[best], kind="stable")]
        taken, chosen = set(), []
        for s, three in zip(best.tolist(), mixes[best].tolist(), strict=True):
            if not taken.intersection(three):
                chosen.append(s)
                taken.update(v for v in three if v)
        chosen = np.array(chosen)
        x[chosen] += move[chosen]
        for side in (a, b, c):
            rest[side[chosen]] -= move[chosen]
        if np.abs(move[chosen]).max() < 0.5:
            break
    return x


@dataclass
class Plan:
    """Where tails go. Slot rows (by length, then first number): a tail of that length numbered from
    ``first`` on lies at ``offset`` of sequence ``sequence`` + its number - ``first``. Tails beyond the
    slots of their length form a stream; a stretch of it from ``at`` on fills gaps of ``gap`` ids, one in
    each sequence from ``gap_sequence`` on, at ``gap_offset``."""

    window: int
    slot_key: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    used: np.ndarray
    stream: np.ndarray
    at: np.ndarray
    gap: np.ndarray
    gap_sequence: np.ndarray
    gap_offset: np.ndarray


def _whole_combinations(left: np.ndarray, window: int) -> list[tuple[list[tuple[int, int]], int]]:
    """([(length, times)], repeats) of the rounded solution, as far as there are tails in ``left``, which they leave."""
    mixes = combinations(left, window)
    x = np.rint(repeat_counts(left, mixes)).astype(np.int64)
    out = []
    for s in np.argsort(-x, kind="stable")[: int((x > 0).sum())].tolist():
        times: dict[int, int] = {}
        for v in mixes[s].tolist():
            if v:
                times[v] = times.get(v, 0) + 1
        n = min(int(x[s]), *(int(left[v]) // k for v, k in times.items()))
        if n > 0:
            for v, k in times.items():
                left[v] -= n * k
            out.append((sorted(times.items(), reverse=True), n))
    return out


def _greedy(left: np.ndarray, window: int) -> list[tuple[list[tuple[int, int]], int]]:
    """The same for the rest: the longest tail, then again and again the longest that fits."""
    below = np.arange(len(left))

    def longest(limit: int) -> int:
        """The longest length up to ``limit`` with tails left, or 0."""
        path = []
        while limit > 0 and left[limit] == 0:
            path.append(limit)
            limit = int(below[limit]) if below[limit] < limit else limit - 1
        below[path] = limit
        return limit

    out = []
    while top := longest(len(left) - 1):
        times, room, v = [], window, top
        while v:
            k = min(room // v, int(left[v]))
            times.append((v, k))
            room -= k * v
            v = longest(min(room, v - 1))
        n = min(int(left[v]) // k for v, k in times)
        for v, k in times:
            left[v] -= n * k
        out.append((times, n))
    return out


def make_plan(histogram: np.ndarray, window: int, sequences: int = 0) -> Plan:
    """Places for ``histogram[r]`` tails of each length r below ``window``; ``sequences`` numbers are taken."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    recipes = _whole_combinations(left, window)
    open_ = []
    fill = lambda times: sum(v * k for v, k in times)
    for times, n in _greedy(left, window):
        (recipes if window - fill(times) <= window // CRUMB else open_).append((times, n))
    open_.sort(key=lambda r: -fill(r[0]))
    keep = sum(fill(t) * n for t, n in open_) // window
    used, slots, gaps = np.zeros(window, np.int64), [], []

    def place(times, n):
        nonlocal sequences
        at = 0
        for v, k in times:
            for _ in range(k):
                slots.append((v, int(used[v]), sequences, at))
                used[v] += n
                at += v
        sequences += n
        return at

    for times, n in recipes:
        place(times, n)
    for times, n in open_:
        if kept := min(n, keep):
            begin = sequences
            end = place(times, kept)
            gaps.append((window - end, kept, begin, end))
            keep -= kept
    gaps.sort(key=lambda g: -g[0])
    rest = histogram.astype(np.int64) - used
    rest[0] = 0
    lengths = np.arange(window)
    # The stream has the longest tails first.
    tokens = (rest * lengths)[::-1]
    stream = (np.cumsum(tokens) - tokens)[::-1]
    over = int(tokens.sum()) - sum(g * n for g, n, _, _ in gaps)
    for bit in range(window.bit_length(), -1, -1):
        if over >> bit & 1:
            gaps.append((1 << bit, 1, sequences, 0))
            sequences += 1
    s = np.array(sorted(slots), np.int64).reshape(-1, 4)
    g = np.array(gaps, np.int64).reshape(-1, 4)
    size = g[:, 0] * g[:, 1]
    return Plan(window, (s[:, 0] << _TAIL_SHIFT) | s[:, 1], s[:, 1], s[:, 2], s[:, 3], used, stream, np.cumsum(size) - size, g[:, 0], g[:, 2], g[:, 3])


def tail_pieces(plan: Plan, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
    """(tail, begin, size, sequence, offset) of the pieces of tails with these lengths and numbers."""
    whole = np.flatnonzero(number < plan.used[length])
    slot = np.searchsorted(plan.slot_key, (length[whole] << _TAIL_SHIFT) | number[whole], side="right") - 1
    out = [(whole, np.zeros(len(whole), np.int64), length[whole], plan.sequence[slot] + number[whole] - plan.first[slot], plan.offset[slot])]
    tail = np.flatnonzero(number >= plan.used[length])
    at = plan.stream[length[tail]] + (number[tail] - plan.used[length[tail]]) * length[tail]
    begin, left = np.zeros(len(tail), np.int64), length[tail].copy()
    while len(tail):
        k = np.searchsorted(plan.at, at, side="right") - 1
        n, inside = np.divmod(at - plan.at[k], plan.gap[k])
        size = np.minimum(left, plan.gap[k] - inside)
        out.append((tail, begin, size, plan.gap_sequence[k] + n, plan.gap_offset[k] + inside))
        at, begin, left = at + size, begin + size, left - size
        on = left > 0
        tail, at, begin, left = tail[on], at[on], begin[on], left[on]
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenised(docs: DataFrame, window: int, id_col: str, text_col: str, path: str | None) -> DataFrame:
    """The stored ids: block, id, tail, number (of the tail among its length's in the block), windows (whole
    ones of earlier rows in the block), n and ids, as little-endian integers of two bytes, or four if need be."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("block", T.LongType()), rows.schema["id"], *T._parse_datatype_string("tail int, number long, windows long, n long, ids binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bytepairs.vocabulary(_path(path))
        kind = "<u2" if words.library.get_vocab_size() <= 1 << 16 else "<u4"
        block, seen, windows = TaskContext.get().partitionId(), np.zeros(window, np.int64), 0
        for batch in held_until_done(batches):
            for lo, hi, texts in bytepairs.text_slices(batch.column("text")):
                ids, edge = words.encode(texts)
                n = np.diff(edge) + 1
                ids = np.insert(ids, edge[1:], END_ID).astype(kind)
                tail = n % window
                order = np.argsort(tail, kind="stable")
                head = np.flatnonzero(np.diff(tail[order], prepend=-1))
                number = np.empty(len(n), np.int64)
                number[order] = np.arange(len(n)) - np.repeat(head, np.diff(np.append(head, len(n))))
                number += seen[tail]
                seen += np.bincount(tail, minlength=window)
                before = windows + np.cumsum(n // window) - n // window
                windows += int((n // window).sum())
                width = ids.itemsize
                data = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(n * width)]).astype(np.int64)), pa.py_buffer(ids)])
                columns = [np.full(len(n), block), None, tail.astype(np.int32), number, before, n]
                made = [batch.column("id").slice(lo, hi - lo) if c is None else pa.array(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*made, data.cast(pa.binary())], names=schema.names)

    return written(rows.mapInArrow(run, schema), "ids", compression="zstd")


def _pieces(batch: pa.RecordBatch, plan: Plan) -> pa.RecordBatch:
    n, tail, windows = (batch.column(c).to_numpy() for c in ("n", "tail", "first_window"))
    full = n // plan.window
    row = np.repeat(np.arange(len(n)), full)
    k = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
    some = np.flatnonzero(tail)
    t, begin, size, sequence, offset = tail_pieces(plan, tail[some].astype(np.int64), batch.column("place").to_numpy()[some])
    row = np.concatenate([row, some[t]])
    start = np.concatenate([k * plan.window, (full * plan.window)[some[t]] + begin])
    order = np.lexsort((start, row))
    size = np.concatenate([np.full(len(k), plan.window), size])[order]
    sequence = np.concatenate([windows[row[: len(k)]] + k, sequence])[order]
    offset = np.concatenate([np.zeros(len(k), np.int64), offset])[order]
    row, start = row[order], start[order]
    packed = batch.column("ids").cast(pa.large_binary())
    edge = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1]
    data = np.frombuffer(packed.buffers()[2], np.uint8)[edge[0] : edge[-1]]
    ids = np.ascontiguousarray(data.view(f"<u{len(data) // max(1, int(n.sum()))}" if len(data) else "<u2").astype("<u4"))
    edges = np.concatenate([[0], np.cumsum(size * 4)]).astype(np.int32)
    cut = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(edges), pa.py_buffer(ids)])
    return pa.RecordBatch.from_arrays(
        [batch.column("id").take(pa.array(row)), *map(pa.array, (start, size)), cut, *map(pa.array, (n[row], sequence, offset))],
        names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, path: str | None = None) -> DataFrame:
    """The pieces of all rows: id, start, length, ids (little-endian, four bytes each), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    stored = tokenised(docs, window, id_col, text_col, path)
    counts = stored.groupBy("block", "tail").agg(F.count("*").alias("k"), F.sum(F.expr(f"n div {window}")).alias("full"))
    counts = written(counts, "counts")
    earlier = lambda *by: Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    by_block = counts.groupBy("block").agg(F.sum("full").alias("full"))
    by_block = by_block.select("block", F.coalesce(F.sum("full").over(earlier(F.lit(0))), F.lit(0)).alias("first_of_block"))
    firsts = counts.select("block", "tail", F.coalesce(F.sum("k").over(earlier("tail")), F.lit(0)).alias("first")).join(by_block, "block")
    histogram, full = np.zeros(window, np.int64), 0
    for r in counts.groupBy("tail").agg(F.sum("k").alias("k"), F.sum("full").alias("full")).collect():
        histogram[r.tail] = r.k
        full += r.full
    plan = spark.sparkContext.broadcast(make_plan(histogram, window, full))
    placed = stored.join(firsts, ["block", "tail"]).select(
        "id", "tail", (F.col("first") + F.col("number")).alias("place"), (F.col("first_of_block") + F.col("windows")).alias("first_window"), "n", "ids")
    schema = T.StructType([placed.schema["id"], *T._parse_datatype_string("start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held_until_done(batches):
            rows = max(1, batch.num_rows * PIECE_BYTES // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, rows):
                yield _pieces(batch.slice(at, rows), plan.value)

    return placed.mapInArrow(run, schema)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

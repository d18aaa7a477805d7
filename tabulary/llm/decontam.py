"""Benchmark decontamination on a distributed positional inverted index.

``build_index`` reads the training texts once and stores their postings: a row per
term and block, a block being a stretch of one partition's texts (``BLOCK_BYTES``, or
one longer text). A row lists every place of the term in the block; a place holds the
text's number in the block and the word's number in the text. Since a term has a row
in each block, even the commonest word is spread over the whole index.

``found`` searches all windows of the benchmark's items, and the items' sets of terms for
proximity. Terms are counted over the whole corpus, from the lengths of their lists. The
lists of the sought terms are then read once and go to their blocks; there the list of a
window's rarest term, moved by the term's offset, gives its candidates, and the lists of its
other terms, rarest first, cut them down. ``near`` finds in the same way the stretches that
hold all distinct terms of an item close together, around the places of its rarest term.

Windows and items are sent to the blocks some ``PART_BYTES`` at a time (or one longer item), so
a benchmark of any size passes in bounded parts. A task holds one block's lists. Words are
told apart by a 64-bit hash.

Defined results: a null or empty text has no words and no hits; very long texts are
blocks of their own; a benchmark item without words is never found; a shorter item than
``size`` is one window of its own length; rows with equal or null ids stay separate; an
empty benchmark leaves all rows clean, an empty table gives none. A benchmark item with
a null id marks hits like any other, but is not in the list of items and so not in their
number; items of one id count once. Columns of the input that an index does not keep
are not read, so their names cannot clash; kept ones may not be called like its own
(``block``, ``ord``, ``n_words``, ``term``, ``n``, ``places``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulary.llm import bytewords as bw
from tabulary.llm.arrowmap import apart, held_until_done, written

SIZE = 10
SLOP = 5
BLOCK_BYTES = 4 << 20
PART_BYTES = 4 << 20
#: Kinds of what is sought.
_PHRASE, _NEAR = 0, 1
_SHIFT = 32
_KEY = ["block", "ord"]


@dataclass(frozen=True)
class Index:
    """``texts``: block, ord, the kept columns and n_words of each row; ``postings``: block, term, n, places."""

    texts: DataFrame
    postings: DataFrame


def _lists(edges: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values))


def _words(data: np.ndarray, offsets: np.ndarray) -> bw.Words:
    return bw.find_words(data, offsets, bw.LETTERS, lower=True)


def build_index(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> Index:
    """The stored index of ``docs``; ``keep`` columns go with each text."""
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    kept = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields[:-1]])
    schema = T.StructType([*T._parse_datatype_string("block long, ord int, n_words long, term long, n int, places array<bigint>"), *kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 40
        for batch in held_until_done(batches):
            for lo, hi, data, offsets in bw.slices(batch.column("__text"), BLOCK_BYTES):
                w = _words(data, offsets)
                n = hi - lo
                own = [batch.column(c).slice(lo, n) for c in kept.names]
                texts = [np.full(n, block), np.arange(n, dtype=np.int32), np.diff(w.first).astype(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, texts), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), *own], names=schema.names)
                h = bw.word_hashes(w)
                doc = w.doc
                place = (doc << _SHIFT) | (np.arange(len(h)) - w.first[doc])
                order = np.argsort(h, kind="stable")
                h = h[order]
                edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]])) if len(h) else np.zeros(1, np.int64)
                t = len(edge) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(t, block)), pa.nulls(t, pa.int32()), pa.nulls(t, pa.int64()), pa.array(h[edge[:-1]].view(np.int64)), pa.array(np.diff(edge).astype(np.int32)),
                     _lists(edge, place[order]), *(pa.nulls(t, c.type) for c in own)], names=schema.names)
                block += 1

    stored = written(rows.mapInArrow(run, schema), "index", compression="zstd")
    return Index(stored.where("ord is not null").drop("term", "n", "places"), stored.where("term is not null").select("block", "term", "n", "places"))


def _windows(items: DataFrame, size: int) -> DataFrame:
    """(item row k, terms in order) of every window of ``size`` words; null ``size``: all distinct terms of the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held_until_done(batches):
            for lo, hi, data, offsets in bw.slices(batch.column("text"), BLOCK_BYTES // 32):
                w = _words(data, offsets)
                h = bw.word_hashes(w).view(np.int64)
                k = batch.column("k").to_numpy()[lo:hi]
                if size is None:
                    one = [np.unique(h[a:b]) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                    owner = k
                else:
                    begin = np.arange(len(h))
                    length = np.minimum(size, np.diff(w.first))[w.doc]
                    whole = begin + length <= w.first[w.doc + 1]
                    one = [h[a:b] for a, b in zip(begin[whole], (begin + length)[whole], strict=True)]
                    owner = k[w.doc[whole]]
                edges = np.concatenate([[0], np.cumsum([len(x) for x in one])])
                yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), _lists(edges, np.concatenate([*one, np.zeros(0, np.int64)]))], names=["k", "terms"])

    return items.select("k", "text").mapInArrow(run, "k long, terms array<bigint>").where(F.size("terms") > 0)


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return written(rows.withColumn("k", F.monotonically_increasing_id()), "items")


def _of_terms(index: Index, terms: DataFrame) -> DataFrame:
    """The postings of ``terms``. The set of terms is written first: where it is small, Spark
    knows so before it plans the join, and filters the index where it lies."""
    return index.postings.join(written(terms.distinct(), "terms"), "term", "left_semi")


def _rarest_first(sought: DataFrame, index: Index) -> DataFrame:
    """``sought`` (kind, id, terms) with terms as struct<n, j, term>, the rarest first, n counted over the
    whole corpus and j the term's offset; those with a term that the corpus lacks go."""
    each = sought.select("kind", "id", F.size("terms").alias("size"), F.posexplode("terms").alias("j", "term"))
    counts = written(_of_terms(index, each.select("term")).groupBy("term").agg(F.sum("n").alias("n")), "counts")
    found = each.join(counts, "term").groupBy("kind", "id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "j", "term"))).alias("terms"))
    return written(found.where(F.size("terms") == F.col("size")).select("kind", "id", "terms"), "ranked")


@dataclass(frozen=True)
class _Part:
    """Some windows and items: kind, id, and for each a stretch of offsets and terms."""

    kinds: np.ndarray
    ids: np.ndarray
    edge: np.ndarray
    offsets: np.ndarray
    terms: np.ndarray


def _parts(ranked: DataFrame, size: int) -> Iterator[_Part]:
    """All of ``ranked``, about ``size`` bytes at a time; nothing else reaches the driver."""
    held, count = [], 0

    def part() -> _Part:
        flat = np.array([(t.j, t.term) for r in held for t in r.terms], np.int64).reshape(-1, 2)
        return _Part(np.array([r.kind for r in held]), np.array([r.id for r in held], np.int64), np.cumsum([0, *(len(r.terms) for r in held)]), flat[:, 0].copy(), flat[:, 1].copy())

    for r in ranked.orderBy("kind", "id").toLocalIterator():
        if held and 16 * (count + len(r.terms)) > size:
            yield part()
            held, count = [], 0
        held.append(r)
        count += len(r.terms)
    if held:
        yield part()


def _holds(places: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(places, wanted)
    return places[np.minimum(at, len(places) - 1)] == wanted


def _close(anchors: np.ndarray, places: list[np.ndarray], reach: int) -> np.ndarray:
    """The anchors that have a place of each list less than ``reach`` away."""
    for p in places:
        if not len(anchors):
            break
        k = np.searchsorted(p, anchors)
        after, before = p[np.minimum(k, len(p) - 1)] - anchors, anchors - p[np.maximum(k - 1, 0)]
        anchors = anchors[((k < len(p)) & (after < reach)) | ((k > 0) & (before < reach))]
    return anchors


def _least_stretches(anchors: np.ndarray, places: list[np.ndarray], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the shortest stretches (the first of equal ones) of less than ``reach`` words that
    hold an anchor and a place of each list; each once.

    A stretch may begin up to ``reach`` words before its anchor; from each such begin it ends
    with the last of the lists' next places.
    """
    begins, ends = [], []
    for some in np.array_split(anchors, max(1, len(anchors) * reach >> 20)):
        begin = some[:, None] - np.arange(reach - 1, -1, -1)
        end = np.repeat(some[:, None], reach, axis=1)
        for p in places:
            k = np.searchsorted(p, begin)
            end = np.maximum(end, np.where(k < len(p), p[np.minimum(k, len(p) - 1)], np.iinfo(np.int64).max))
        size = end - begin
        best = np.argmin(size, axis=1)
        row = np.flatnonzero(size[np.arange(len(some)), best] < reach)
        begins.append(begin[row, best[row]])
        ends.append(end[row, best[row]] + 1)
    both = np.unique(np.stack([np.concatenate(begins), np.concatenate(ends)], 1), axis=0)
    return both[:, 0], both[:, 1]


def _in_block(part: _Part, slop: int):
    """Rows (kind, block, ord, id, begin, end) of a block: places of whole windows, and stretches of near terms."""

    def run(lists: pa.Table) -> pa.Table:
        column = lists.column("places").combine_chunks()
        flat, edge = column.flatten().to_numpy(), column.offsets.to_numpy() - (column.offsets[0].as_py() if len(column) else 0)
        have = {t: flat[a:b] for t, a, b in zip(lists.column("term").to_pylist(), edge[:-1], edge[1:], strict=True)}
        rows = []
        for k, (kind, a, b) in enumerate(zip(kinds, edges[:-1], edges[1:], strict=True)):
            if terms[a] not in have or not all(t in have for t in terms[a + 1 : b]):
                continue
            if kind == _PHRASE:
                at = have[terms[a]] - offsets[a]
                for i in range(a + 1, b):
                    at = at[_holds(have[terms[i]], at + offsets[i])]
                    if not len(at):
                        break
                end = at + (b - a)
            else:
                places = [have[t] for t in terms[a + 1 : b]]
                at, end = _close(have[terms[a]], places, b - a + slop), None
                if len(at):
                    at, end = _least_stretches(at, places, b - a + slop)
            if len(at):
                rows.append((k, at, end))
        n = [len(at) for _, at, _ in rows]
        which = np.repeat(np.array([k for k, *_ in rows], np.int64), n)
        begin, end = (np.concatenate([*(r[i] for r in rows), np.zeros(0, np.int64)]).astype(np.int64) for i in (1, 2))
        low = (1 << _SHIFT) - 1
        block = lists.column("block")[0].as_py() if lists.num_rows else 0
        return pa.table({"kind": pa.array(part.kinds[which], pa.int32()), "block": pa.array(np.full(len(begin), block), pa.int64()), "ord": pa.array((begin >> _SHIFT).astype(np.int32)),
                         "id": pa.array(part.ids[which]), "begin": pa.array((begin & low).astype(np.int32)), "end": pa.array((end & low).astype(np.int32))})

    kinds, edges, terms, offsets = part.kinds.tolist(), part.edge.tolist(), part.terms.tolist(), part.offsets.tolist()
    return run


@dataclass(frozen=True)
class Found:
    """``hits``: kind, block, ord, id, begin, end; ``items``: k, item, text; ``owners``: id of a window, item."""

    hits: DataFrame
    items: DataFrame
    owners: DataFrame


def find(index: Index, benchmark: DataFrame, *, item_col: str = "item_id", item_text_col: str = "text", size: int | None = SIZE, slop: int | None = SLOP, part_bytes: int = PART_BYTES) -> Found:
    """All windows of ``size`` words and all stretches of near terms; either may be left out (null)."""
    items = _items(benchmark, item_col, item_text_col)
    cut = _windows(items, size) if size is not None else items.select("k", F.array().cast("array<bigint>").alias("terms")).limit(0)
    windows = written(cut.select("terms").distinct().withColumn("id", F.monotonically_increasing_id()), "windows")
    owners = cut.join(windows, "terms").join(items.select("k", "item").where("item is not null"), "k").select("id", "item").distinct()
    sought = windows.select(F.lit(_PHRASE).alias("kind"), "id", "terms")
    if slop is not None:
        sought = sought.unionByName(_windows(items, None).select(F.lit(_NEAR).alias("kind"), F.col("k").alias("id"), "terms"))
    ranked = _rarest_first(sought, index)
    schema = "kind int, block long, ord int, id long, begin int, end int"
    hits = None
    for part in _parts(ranked, part_bytes):
        own = ranked.where(F.struct("kind", "id").between(_mark(part, 0), _mark(part, -1))).select(F.explode("terms.term").alias("term"))
        one = _of_terms(index, own).select("block", "term", "places").groupBy("block").applyInArrow(_in_block(part, slop or 0), schema)
        hits = one if hits is None else hits.unionByName(one)
    hits = index.postings.sparkSession.createDataFrame([], schema) if hits is None else hits
    return Found(written(hits, "hits"), items, owners)


def _mark(part: _Part, at: int) -> Column:
    return F.struct(F.lit(int(part.kinds[at])).alias("kind"), F.lit(int(part.ids[at])).cast("long").alias("id"))


def _merged_spans(spans: Column) -> Column:
    """Begin, end, begin, end ... of the sorted disjoint spans that cover the given ones."""
    last = lambda a: F.element_at(a, -1)
    longer = lambda a, x: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.greatest(last(a), x["end"])))
    add = lambda a, x: F.when((F.size(a) > 0) & (x["begin"] <= last(a)), longer(a, x)).otherwise(F.concat(a, F.array(x["begin"], x["end"])))
    return F.aggregate(F.array_sort(spans), F.array().cast("array<int>"), add)


def phrases(found: Found) -> DataFrame:
    """(block, ord, hits, items) of the texts with hits: word spans (begin, end, begin, end ...), and
    the sorted ids, without nulls, of the items that share a window with the text."""
    own = found.hits.where(F.col("kind") == _PHRASE)
    spans = own.groupBy(*_KEY).agg(_merged_spans(F.collect_set(F.struct("begin", "end"))).alias("hits"))
    named = own.select(*_KEY, "id").distinct().join(found.owners, "id").groupBy(*_KEY).agg(F.array_sort(F.collect_set("item")).alias("items"))
    return spans.join(named, _KEY, "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def near(found: Found) -> DataFrame:
    """Proximity matches (block, ord, item, begin, end): the stretches of one text that hold all
    distinct terms of an item and are shorter than their number plus the slop.

    For each place of the item's rarest term the shortest covering stretch is given, once per (begin, end).
    """
    own = found.hits.where(F.col("kind") == _NEAR)
    return own.join(found.items.select(F.col("k").alias("id"), "item"), "id").select(*_KEY, "item", "begin", "end")


def find_phrases(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(id_col, n_words, hits, items) of each row of ``docs``; see ``phrases``."""
    index = build_index(docs, (id_col,), text_col)
    return _all_texts(index, phrases(find(index, benchmark, item_col=item_col, item_text_col=item_text_col, size=size, slop=None))).drop(*_KEY)


def _all_texts(index: Index, found: DataFrame) -> DataFrame:
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return index.texts.join(found, _KEY, "left").select(*index.texts.columns, none("hits", "int"), none("items", "string"))


def find_near(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
              item_text_col: str = "text", slop: int = SLOP) -> DataFrame:
    """(id_col, item, begin, end); see ``near``."""
    index = build_index(docs, (id_col,), text_col)
    found = near(find(index, benchmark, item_col=item_col, item_text_col=item_text_col, size=None, slop=slop))
    return found.join(index.texts, _KEY).select(id_col, "item", "begin", "end")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sought = find(index, benchmark)
    close = near(sought).groupBy(*_KEY).agg(F.count("*").alias("n_near"))
    found = _all_texts(index, phrases(sought)).join(close, _KEY, "left")
    signed = F.transform("hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long"))
    n_hit = F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )


def clean_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that share no window with the benchmark.

    A text decides by its content alone, so texts with hits are named by a 128-bit hash.
    """
    names = ("__text_a", "__text_b")
    marked = lambda d: d.withColumns({names[0]: F.xxhash64("text"), names[1]: F.xxhash64(F.lit(1), "text")})
    index = build_index(marked(docs.select("text")), names)
    found = phrases(find(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=None))
    dirty = written(index.texts.join(found, _KEY, "left_semi").select(*names).distinct(), "dirty")
    return apart(docs, names, lambda d: marked(d).join(dirty, list(names), "left_anti"))

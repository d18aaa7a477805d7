"""Ranked lexical search over a two-level quantised index.

``build_index`` reads all texts twice: once for the number of documents and terms, which
every impact needs, and once for the postings. A posting's impact is
(10^9 tf) div (1000 tf + 8 m), an integer below 10^6; the first level keeps it as a byte,
rounded up to a multiple of ``UNIT``, so a byte times ``UNIT`` is never less than the impact
and the byte below it is. The second level keeps the term frequency, which with
the text's m gives the impact exactly. A row holds one term's postings of one block, a block
being a stretch of one partition's texts (``BLOCK_BYTES``, or one longer text); the commonest
term is spread over all blocks.

``search`` takes the queries in parts of bounded size (``PART_BYTES`` of their terms). The
postings of a part's terms meet block by block: sums of bytes times weights bound every
document's score from above and below, each query's k-th highest lower bound is found, and
every document whose upper bound reaches it is scored again, exactly, in 64-bit integers.
The best k of the blocks are merged by Spark. A block's k-th lower bound is at most that of
the whole corpus, so no document is lost, and equal scores are settled by the ids at each step.

Defined results: null and empty texts have no terms and are never found; a query without
terms, or none of whose terms occurs, has no rows; a null query text likewise. Queries with
equal or null ids are ranked each on its own, rows with equal ids are documents of their own.
Equal scores are ordered by the document's id, null last, then by the row's place. Very long
texts are blocks of their own. Empty tables give no rows. Columns other than the ids and
the texts are not read. Terms are told apart by a 64-bit hash.
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

from tabulary.llm import bytewords as bw
from tabulary.llm.arrowmap import held_until_done, written

TOP = 10
BLOCK_BYTES = 4 << 20
PART_BYTES = 4 << 20
#: Impacts stay below 10^6; 255 steps of this size cover them.
UNIT = 3922


@dataclass(frozen=True)
class Index:
    """``texts``: block, ord, id, m of each text with terms; ``postings``: block, term, ords, levels, counts
    (little-endian integers of 4, 1 and 4 bytes); n and length: documents with terms, and all their terms."""

    texts: DataFrame
    postings: DataFrame
    n: int
    length: int


def _words(data: np.ndarray, offsets: np.ndarray) -> bw.Words:
    return bw.find_words(data, offsets, bw.LETTERS, lower=True)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = length = 0
    for batch in held_until_done(batches):
        for _, _, data, offsets in bw.slices(batch.column("text"), BLOCK_BYTES):
            words = np.diff(_words(data, offsets).first)
            n, length = n + int((words > 0).sum()), length + int(words.sum())
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([length])], names=["n", "length"])


def spread(words: np.ndarray, n: int, length: int) -> np.ndarray:
    """m, a text's length against the mean, in hundredths."""
    return 25 + 75 * words * n // max(length, 1)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _bytes(edge: np.ndarray, values: np.ndarray) -> pa.Array:
    """One binary value for each stretch of ``values``."""
    width = values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((edge * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The stored index of ``docs``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = rows.select("text").mapInArrow(_sizes, "n long, length long").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).first()
    n_docs, length = total.n or 0, total.length or 0
    schema = T.StructType([*T._parse_datatype_string("block long, ord int, m long, term long, ords binary, levels binary, counts binary"), rows.schema["id"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 40
        for batch in held_until_done(batches):
            for lo, hi, data, offsets in bw.slices(batch.column("text"), BLOCK_BYTES):
                w = _words(data, offsets)
                words = np.diff(w.first)
                some = np.flatnonzero(words)
                m = spread(words, n_docs, length)
                ids = batch.column("id").slice(lo, hi - lo)
                blank = lambda k, *kinds: [pa.nulls(k, t) for t in kinds]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), block)), pa.array(some.astype(np.int32)), pa.array(m[some]), *blank(len(some), pa.int64(), pa.binary(), pa.binary(), pa.binary()),
                     ids.take(pa.array(some))], names=schema.names)
                h, doc = bw.word_hashes(w), w.doc
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                tf, term, doc = np.diff(np.append(first, len(h))), h[first], doc[first]
                level = -(-impacts(tf, m[doc]) // UNIT)
                edge = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1], [True]])) if len(term) else np.zeros(1, np.int64)
                t = len(edge) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(t, block)), *blank(t, pa.int32(), pa.int64()), pa.array(term[edge[:-1]].view(np.int64)),
                     _bytes(edge, doc.astype("<u4")), _bytes(edge, level.astype(np.uint8)), _bytes(edge, tf.astype("<u4")), pa.nulls(t, ids.type)], names=schema.names)
                block += 1

    stored = written(rows.mapInArrow(run, schema), "ranking", compression="zstd")
    return Index(stored.where("ord is not null").select("block", "ord", "id", "m"), stored.where("term is not null").select("block", "term", "ords", "levels", "counts"), n_docs, length)


def _query_terms(queries: DataFrame) -> DataFrame:
    """(query, term, times, words) of each distinct term of a query, ``words`` being the number of the query's distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held_until_done(batches):
            key = batch.column("query").to_numpy()
            for lo, hi, data, offsets in bw.slices(batch.column("text")):
                w = _words(data, offsets)
                h = bw.word_hashes(w)
                for i in range(hi - lo):
                    term, times = np.unique(h[w.first[i] : w.first[i + 1]], return_counts=True)
                    k = len(term)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(k, key[lo + i])), pa.array(term.view(np.int64)), pa.array(times), pa.array(np.full(k, k))], names=["query", "term", "times", "words"])

    return queries.mapInArrow(run, "query long, term long, times long, words long")


@dataclass(frozen=True)
class Part:
    """Some queries: their numbers, and for each a stretch of terms with weight times occurrences."""

    queries: np.ndarray
    edge: np.ndarray
    terms: np.ndarray
    weights: np.ndarray


def _parts(terms: DataFrame, size: int) -> Iterator[Part]:
    """The queries' weighted terms, some ``size`` bytes at a time (or one longer query); nothing else reaches the driver."""
    held, count = [], 0
    rows = terms.groupBy("query").agg(F.collect_list(F.struct("term", "weight")).alias("terms")).orderBy("query")
    for r in rows.toLocalIterator():
        if held and 16 * (count + len(r.terms)) > size:
            yield _part(held)
            held, count = [], 0
        held.append(r)
        count += len(r.terms)
    if held:
        yield _part(held)


def _part(rows: list) -> Part:
    flat = np.array([(t.term, t.weight) for r in rows for t in r.terms], np.int64).reshape(-1, 2)
    return Part(np.array([r["query"] for r in rows]), np.cumsum([0, *(len(r.terms) for r in rows)]), flat[:, 0].copy(), flat[:, 1].copy())


def _best(scores: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Rows of the ``k`` highest scores, equal ones by ascending rank."""
    return np.lexsort((rank, -scores))[:k]


def _search_block(part: Part, k: int):
    """(query, id, block, ord, score) of a block's best ``k`` documents for each query."""

    def run(postings: pa.Table, texts: pa.Table) -> pa.Table:
        ord_, m = (texts.column(c).to_numpy() for c in ("ord", "m"))
        n = int(ord_.max()) + 1 if len(ord_) else 0
        spread_of, rank = np.zeros(n, np.int64), np.zeros(n, np.int64)
        spread_of[ord_] = m
        keys = pa.table({"id": texts.column("id"), "ord": texts.column("ord")}).sort_by([("id", "ascending"), ("ord", "ascending")])
        rank[keys.column("ord").to_numpy()] = np.arange(len(ord_))
        at = np.searchsorted(sorted_terms, postings.column("term").to_numpy())
        columns = (postings.column(c).to_pylist() for c in ("ords", "levels", "counts"))
        lists = {int(t): (np.frombuffer(o, "<u4"), np.frombuffer(v, np.uint8), c) for t, o, v, c in zip(at, *columns, strict=True)}
        rows_q, rows_d, rows_s = [], [], []
        upper, fewer = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for q in range(len(part.queries)):
            span = slice(part.edge[q], part.edge[q + 1])
            met = [(lists[t], w) for t, w in zip(place[span].tolist(), part.weights[span].tolist(), strict=True) if t in lists and w > 0]
            if not met:
                continue
            upper[:] = fewer[:] = 0
            # A byte v bounds its impact by v UNIT from above and by (v - 1) UNIT + 1 from below.
            for (docs, level, _), w in met:
                upper[docs] += w * level.astype(np.int64)
                fewer[docs] += w
            upper *= UNIT
            lower = np.where(fewer > 0, upper - (UNIT - 1) * fewer, 0)
            limit = max(int(np.partition(lower, n - k)[n - k]), 1) if n > k else 1
            near = np.flatnonzero(upper >= limit)
            score, index = np.zeros(len(near), np.int64), np.full(n, -1, np.int64)
            index[near] = np.arange(len(near))
            for (docs, _, counts), w in met:
                here = index[docs]
                hit = np.flatnonzero(here >= 0)
                if len(hit):
                    tf = np.frombuffer(counts, "<u4")[hit].astype(np.int64)
                    score[here[hit]] += w * impacts(tf, spread_of[docs[hit]])
            good = np.flatnonzero(score > 0)
            best = good[_best(score[good], rank[near[good]], k)]
            rows_q.append(np.full(len(best), part.queries[q]))
            rows_d.append(near[best])
            rows_s.append(score[best])
        query, doc, score = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (rows_q, rows_d, rows_s))
        back = np.zeros(n, np.int64)
        back[ord_] = np.arange(len(ord_))
        block = texts.column("block")[0].as_py() if len(ord_) else 0
        found = texts.column("id").combine_chunks().take(pa.array(back[doc])) if n else texts.column("id").combine_chunks()
        return pa.table({"query": query, "id": found, "block": np.full(len(doc), block), "ord": doc, "score": score})

    sorted_terms = np.unique(part.terms)
    place = np.searchsorted(sorted_terms, part.terms)
    return run


def _named(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = queries.select(F.col(id_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return written(rows.withColumn("query", F.monotonically_increasing_id()), "queries")


def search(index: Index, queries: DataFrame, *, id_col: str = "item_id", text_col: str = "text", k: int = TOP, part_bytes: int = PART_BYTES) -> DataFrame:
    """(item, rank, id, score) of each query's ``k`` best documents with a score above 0."""
    spark = queries.sparkSession
    named = _named(queries, id_col, text_col)
    terms = written(_query_terms(named.select("query", "text")), "query_terms")
    wanted = written(terms.select("term").distinct(), "terms")
    held = written(index.postings.join(wanted, "term", "left_semi"), "lists")
    df = held.groupBy("term").agg(F.sum(F.expr("octet_length(levels)")).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(index.n) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weighted = written(terms.join(df, "term").select("query", "term", (F.col("times") * weight).alias("weight")), "weights")
    schema = T.StructType([*T._parse_datatype_string("query long, block long, ord long, score long"), index.texts.schema["id"]])
    schema = T.StructType([schema["query"], schema["id"], schema["block"], schema["ord"], schema["score"]])
    found = None
    for part in _parts(weighted, part_bytes):
        lists = held.join(weighted.where(F.col("query").between(int(part.queries[0]), int(part.queries[-1]))).select("term").distinct(), "term", "left_semi")
        one = lists.groupBy("block").cogroup(index.texts.groupBy("block")).applyInArrow(_search_block(part, k), schema)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), "block", "ord")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(named.select("query", "item"), "query").select("item", "rank", "id", "score")


def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


#: DuckDB's form of the same ranking.
OP12_SQL = """
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
docs AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
corpus AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS l FROM docs),
dfs AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, corpus GROUP BY term, big_n),
sought AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL),
spread AS (SELECT doc_id, 25 + (75 * n * big_n) // l AS m FROM docs, corpus),
scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM sought JOIN dfs USING (term) JOIN tfs USING (term) JOIN spread USING (doc_id) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""

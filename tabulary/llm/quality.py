"""Quality classifier: boosted trees over statistics of the text alone.

The trees learn from at most ``SAMPLE_ROWS`` labelled documents, those with the
smallest hash of their id, so that the driver holds a fixed number of vectors of
``FEATURES``; the scores cover every document. Statistics come from the text's
bytes; labels, language, source and id are never among them.

Defined results: null and empty texts have all statistics zero and are scored
like any other; of repeated labels of one id the least holds; labels that are
null or whose document is missing teach nothing; without labels of both kinds
every score is the share of label 1 (a half without labels). Of labelled documents with
equal hashes that the sample cannot all take, the least ids are taken; rows with equal texts
have equal scores, and repeated rows stay. A very long text is measured whole, as a slice of
its own; an empty table gives no rows. Input columns named like an output column are
replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.llm import boosting
from tabulary.llm import bytewords as bw
from tabulary.llm.arrowmap import add_columns, apart

#: Most labelled documents that the trees are fitted on.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "symbols", "marks", "digits", "upper", "high_bytes", "short_words", "long_words",
    "adjacent_same", "distinct_words", "repeated_triples", "duplicate_lines", "line_words", "capital_words", "symbol_words", "sentence_words",
)


def _lookup(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars, np.uint8))


_SYMBOL = _lookup(b"#*$%&|<>{}[]~^_=\\@")
_MARK = _lookup(b"!?;:")
_STOP = _lookup(b".!?")
_DIGIT = _lookup(b"0123456789")
_UPPER = _lookup(bytes(range(65, 91)))
_HIGH = np.arange(256) >= 128
_NEWLINE = _lookup(b"\n")


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(x)])
    return total[first[1:]] - total[first[:-1]]


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of h in each document."""
    keyed = h ^ bw.mix((doc + 1).astype(np.uint64))
    order = np.argsort(keyed, kind="stable")
    keyed, doc = keyed[order], doc[order]
    new = np.ones(len(keyed), bool)
    new[1:] = keyed[1:] != keyed[:-1]
    return np.bincount(doc[new], minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, len(FEATURES)) statistics of a run of texts."""
    n = len(offsets) - 1
    w = bw.find_words(data, offsets, bw.SPACED)
    size, words = np.diff(offsets), np.diff(w.first)
    some, many = np.maximum(size, 1), np.maximum(words, 1)
    share = lambda table: _sums(table[data], offsets) / some
    h, doc, wide = bw.word_hashes(w), w.doc, w.end - w.start
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    triples = bw.window_hashes(h, 3)
    whole = doc[: len(triples)] == doc[2:] if len(triples) else np.zeros(0, bool)
    triples, tdoc = triples[whole], doc[: len(whole)][whole]
    n_triples = np.bincount(tdoc, minlength=n)
    broken = bw.find_words(data, offsets, ~_NEWLINE)
    lines, n_lines = bw.word_hashes(broken), np.diff(broken.first)
    head = data[w.start]
    tail = data[w.end - 1]
    columns = [
        np.log1p(size), np.log1p(words), _sums(wide, w.first) / many, share(_SYMBOL), share(_MARK), share(_DIGIT), share(_UPPER), share(_HIGH),
        _sums(wide <= 3, w.first) / many, _sums(wide > 12, w.first) / many, _sums(same, w.first) / many,
        _distinct(h, doc, n) / many, 1 - _distinct(triples, tdoc, n) / np.maximum(n_triples, 1) if len(triples) else np.zeros(n),
        1 - _distinct(lines, broken.doc, n) / np.maximum(n_lines, 1), np.log1p(words / np.maximum(n_lines, 1)),
        _sums(_UPPER[head], w.first) / many, _sums(_SYMBOL[head] | _SYMBOL[tail], w.first) / many,
        np.log1p(words / (_sums(_STOP[tail], w.first) + 1)),
    ]
    return np.where(words[:, None] > 0, np.stack(columns, 1), 0.0)


def _all_statistics(column: pa.Array) -> np.ndarray:
    found = [statistics(data, offsets) for _, _, data, offsets in bw.slices(column)]
    return np.concatenate([*found, np.zeros((0, len(FEATURES)))])


def add_statistics(df: DataFrame, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``statistics``, an array of the ``FEATURES`` of each text."""

    def make(batch: pa.RecordBatch) -> dict:
        x = _all_statistics(batch.column(batch.schema.get_field_index(text_col)))
        at = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
        return {"statistics": pa.ListArray.from_arrays(pa.array(at), pa.array(x.ravel()))}

    return add_columns(df, "statistics array<double>", make, drop=drop)


def remainder(id_col: str = "doc_id", parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> boosting.Forest:
    """Trees from labelled documents outside the held-out fifth, ``rows`` of them at most."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (remainder(id_col) != 0))
    known = known.groupBy(id_col).agg(F.min(label_col).alias("__label"))
    sample = known.orderBy(F.xxhash64(id_col), id_col).limit(rows)
    texts = docs.select(id_col, text_col).join(F.broadcast(sample), id_col)
    found = add_statistics(texts, text_col, drop=(text_col,)).orderBy(id_col, "statistics").limit(rows).collect()
    x = np.array([r["statistics"] for r in found], float).reshape(len(found), len(FEATURES))
    return boosting.fit(x, np.array([r["__label"] > 0 for r in found], float))


def add_score(df: DataFrame, forest: boosting.Forest, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``score``, the probability of label 1."""
    model = df.sparkSession.sparkContext.broadcast(forest)

    def make(batch: pa.RecordBatch) -> dict:
        return {"score": pa.array(model.value.score(_all_statistics(batch.column(batch.schema.get_field_index(text_col)))), pa.float64())}

    return add_columns(df, "score double", make, drop=drop)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = add_score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), drop=("text",))
    return found.select("doc_id", (remainder() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the classifier predicts to be of label 1."""
    forest = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return apart(docs, ("score",), lambda d: add_score(d, forest).where(F.col("score") >= THRESHOLD))

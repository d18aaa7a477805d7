"""Whitening of embeddings from exact integer moments.

Each entry c of a vector becomes the integer floor(256 c). The distinct integer vectors
are the fit list; Spark finds them by grouping on the vectors' bytes, so a vector that
fills a third of the table leaves each map task once. A task subtracts a shift, its first
vector, splits what is left into limbs of 20 bits and multiplies limbs as doubles in runs
so short that every sum stays below 2^53; the products are added as integers of any size
and moved back by the shift. Tasks' sums are merged in a tree of ``FAN_IN``, a row per
task, so neither a task nor the driver holds more than a few d x d tables, d being the
vectors' length. ``n XᵀX - S Sᵀ`` is formed in integers; only then is it rounded to
doubles and taken apart by ``eigh``.

Defined results: rows whose vector is null, empty or holds a null, an infinity or NaN are
dropped. All vectors must have one length; if not, the commonest (of equally common ones
the longest) counts and the rest is dropped. Equal vectors are fitted once but each of
their rows is returned; rows with equal or null ids stay separate. Entries whose
floor(256 c) does not fit 64 bits are held at the nearest 64-bit value. Components whose
eigenvalue is zero to double precision (d 2^-52 of the largest) have no whitened value
(null) and are left out of ``identity_error``. A deviation that does not fit 64 bits is
null; ``deviation_digits`` has its decimal digits at any size. Ties among eigenvalues end
in any basis of their space, the same for all rows. An empty table gives none. Columns
other than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulary.llm.arrowmap import held_until_done, written

SCALE = 256
COMPONENTS = 4
#: Rows of task sums that one task of the next level adds up.
FAN_IN = 16
_LIMB = 20
#: Rows whose limb products add up below 2^53.
_RUN = 1 << (52 - 2 * _LIMB)
_MOMENTS = "n long, sums binary, products binary"


@dataclass(frozen=True)
class Whitening:
    """n fitted vectors with integer sums S, unit eigenvectors by falling eigenvalue, and V's trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def _packed(values) -> bytes:
    """Integers of any size: their common width, then each in that width."""
    flat = [int(v) for v in np.asarray(values, object).ravel()]
    width = max((v.bit_length() // 8 + 1 for v in flat), default=1)
    return width.to_bytes(4, "little") + b"".join(v.to_bytes(width, "little", signed=True) for v in flat)


def _unpacked(data: bytes) -> np.ndarray:
    width = int.from_bytes(data[:4], "little")
    return np.array([int.from_bytes(data[i : i + width], "little", signed=True) for i in range(4, len(data), width)], object)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Signed limbs of 64-bit integers, as doubles; the last one takes what is left."""
    out = []
    while x.any():
        low = ((x + (1 << (_LIMB - 1))) & ((1 << _LIMB) - 1)) - (1 << (_LIMB - 1)) if len(out) < 3 else x
        out.append(low.astype(np.float64))
        x = (x - low) >> _LIMB if len(out) < 4 else np.zeros_like(x)
    return out


def _moments(x: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of x - shift, rows of 64-bit integers, as integers of any size."""
    d = x.shape[1]
    sums, products = np.zeros(d, object), np.zeros((d, d), object)
    wide = bool(len(x)) and max(abs(int(v)) for v in (x.min(), x.max(), shift.min(), shift.max())) >= 1 << 62
    for at in range(0, len(x), _RUN):
        if wide:
            y = x[at : at + _RUN].astype(object) - shift.astype(object)
            sums, products = sums + y.sum(axis=0), products + y.T.dot(y)
            continue
        parts = _limbs(x[at : at + _RUN] - shift)
        for i, a in enumerate(parts):
            sums = sums + (a.sum(axis=0).astype(np.int64).astype(object) << (_LIMB * i))
            for j, b in enumerate(parts[: i + 1]):
                one = (a.T @ b).astype(np.int64).astype(object) << (_LIMB * (i + j))
                products = products + (one if i == j else one + one.T)
    return sums, products


def _bytes(x: np.ndarray) -> list[bytes]:
    """Each row of 64-bit integers in the narrowest width that holds it, so that equal rows have equal bytes."""
    high, low = x.max(axis=1, initial=0), x.min(axis=1, initial=0)
    out = [b""] * len(x)
    left = np.ones(len(x), bool)
    for kind in ("<i2", "<i4", "<i8"):
        held = np.iinfo(kind)
        rows = np.flatnonzero(left & (high <= held.max) & (low >= held.min))
        for i, r in zip(rows.tolist(), x[rows].astype(kind), strict=True):
            out[i] = r.tobytes()
        left[rows] = False
    return out


def _integers(vectors: pa.Array, size: int) -> np.ndarray:
    """The rows of integers that ``_bytes`` packed."""
    packed = vectors.to_pylist()
    width = np.array([len(p) // size for p in packed])
    out = np.empty((len(packed), size), np.int64)
    for k in (2, 4, 8):
        rows = np.flatnonzero(width == k)
        out[rows] = np.frombuffer(b"".join(packed[i] for i in rows.tolist()), f"<i{k}").reshape(-1, size)
    return out


def _task_moments(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products, shift = 0, np.zeros(size, object), np.zeros((size, size), object), None
        for batch in held_until_done(batches):
            if not batch.num_rows:
                continue
            x = _integers(batch.column("x"), size)
            shift = x[0] if shift is None else shift
            s, p = _moments(x, shift)
            n, sums, products = n + len(x), sums + s, products + p
        if n:
            by = shift.astype(object)
            moved = np.outer(sums, by)
            products = products + moved + moved.T + n * np.outer(by, by)
            yield _moment_row(n, sums + n * by, products)

    return run


def _moment_row(n: int, sums: np.ndarray, products: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([_packed(sums)]), pa.array([_packed(products)])], names=["n", "sums", "products"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, sums, products = 0, 0, 0
    for batch in held_until_done(batches):
        for k, s, p in zip(*(batch.column(c).to_pylist() for c in ("n", "sums", "products")), strict=True):
            n, sums, products = n + k, sums + _unpacked(s), products + _unpacked(p)
    if n:
        yield _moment_row(n, sums, products)


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(id, x) of the rows that stay, x being the integers as little-endian bytes, and the vectors' length."""
    good = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("c"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    good = good.where("c is not null and size(c) > 0").where(F.forall("c", finite))
    sizes = good.groupBy(F.size("c").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = sizes["size"] if sizes else 0
    schema = T.StructType([good.schema["id"], T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = float(1 << 63)
        for batch in held_until_done(batches):
            c = np.floor(SCALE * batch.column("c").flatten().to_numpy())
            x = np.where(c >= top, (1 << 63) - 1, np.clip(c, -top, np.nextafter(top, 0)).astype(np.int64)).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_bytes(x), pa.binary())], names=["id", "x"])

    return good.where(F.size("c") == size).mapInArrow(run, schema), size


def fit(vectors: DataFrame, size: int) -> Whitening | None:
    """The whitening of the distinct ``x`` of ``vectors``; None where there are none."""
    sums = written(vectors.select("x").distinct().mapInArrow(_task_moments(size), _MOMENTS), "moments")
    while (left := ceil(sums.count() / FAN_IN)) > 1:
        sums = written(sums.repartition(left).mapInArrow(_merged, _MOMENTS), "moments")
    found = sums.repartition(1).mapInArrow(_merged, _MOMENTS).first()
    if found is None:
        return None
    n, s, products = found.n, _unpacked(found.sums), _unpacked(found.products).reshape(size, size)
    scatter = n * products - np.outer(s, s)
    cov = np.array([[int(v) / (n * n) for v in row] for row in scatter])
    trace = sum(int(scatter[i, i]) for i in range(size)) / (n * n)
    values, columns = np.linalg.eigh(cov)
    return Whitening(n, [int(v) for v in s], values[::-1], columns[:, ::-1], trace)


def whiten(vectors: DataFrame, model: Whitening, components: int = COMPONENTS) -> DataFrame:
    """``vectors`` (id, x) with deviation (exact digits) and whitened, an array by component."""
    n, size = model.n, len(model.sums)
    k = min(components, size)
    real = model.values[:k] > size * 2.0**-52 * max(model.values[0], 0)
    axes = np.where(real, model.vectors[:, :k] / np.sqrt(np.where(real, model.values[:k], 1)), 0)
    total, high = np.array(model.sums, object), max(abs(v) for v in model.sums)
    schema = T.StructType([*vectors.schema.fields, *T._parse_datatype_string("deviation_digits string, whitened array<double>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held_until_done(batches):
            if not batch.num_rows:
                continue
            x = _integers(batch.column("x"), size)
            # n x - S fits 64 bits unless the numbers are very large; so do its halves' squares.
            small = n * max(abs(int(x.min())), abs(int(x.max()))) + high < 1 << 62
            y = n * x - total.astype(np.int64) if small else n * x.astype(object) - total
            if small and size * (int(np.abs(y).max()) ** 2) < 1 << 63:
                far = (y * y).sum(axis=1).tolist()
            else:
                far = [sum(v * v for v in row) for row in y.tolist()]
            at = (y / n).astype(np.float64) @ axes
            flat = pa.array(at.ravel(), mask=~np.tile(real, len(x)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([str(v) for v in far]), lists], names=schema.names)

    return vectors.mapInArrow(run, schema)


def _task_spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, mean, centred products) of a task's whitened rows, or of several such triples."""
    n, mean, spread = 0, 0, 0
    for batch in held_until_done(batches):
        if "whitened" in batch.schema.names:
            rows = np.array(batch.column("whitened").to_pylist(), np.float64).reshape(batch.num_rows, -1)
            m = rows.mean(axis=0) if len(rows) else 0
            parts = [(len(rows), m, (rows - m).T @ (rows - m))] if len(rows) else []
        else:
            lists = zip(*(batch.column(c).to_pylist() for c in ("n", "mean", "spread")), strict=True)
            parts = [(a, np.array(b), np.array(c).reshape(len(b), -1)) for a, b, c in lists]
        for k, m, p in parts:
            gap = m - mean
            spread = spread + p + np.outer(gap, gap) * (n * k / (n + k))
            n, mean = n + k, mean + gap * (k / (n + k))
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean.tolist()]), pa.array([spread.ravel().tolist()])], names=["n", "mean", "spread"])


def identity_error(whitened: DataFrame) -> float | None:
    """Largest absolute entry of the covariance of ``whitened`` (an array of doubles) minus the identity,
    over the components that have values; None where there are none."""
    ddl = "n long, mean array<double>, spread array<double>"
    real = whitened.select(F.filter("whitened", lambda v: v.isNotNull()).alias("whitened")).where(F.size("whitened") > 0)
    sums = written(real.mapInArrow(_task_spread, ddl), "spread")
    while (left := ceil(sums.count() / FAN_IN)) > 1:
        sums = written(sums.repartition(left).mapInArrow(_task_spread, ddl), "spread")
    found = sums.repartition(1).mapInArrow(_task_spread, ddl).first()
    if found is None:
        return None
    k = len(found.mean)
    return float(np.abs(np.array(found.spread).reshape(k, k) / found.n - np.eye(k)).max())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, size = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    schema = T.StructType([T.StructField("vec_id", vectors.schema["id"].dataType), *T._parse_datatype_string(
        "component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string")])
    model = fit(vectors, size) if size else None
    if model is None:
        return spark.createDataFrame([], schema)
    error = identity_error(whiten(vectors.select("x").distinct(), model))
    found = whiten(vectors, model).select("id", "deviation_digits", F.posexplode("whitened").alias("at", "whitened"))
    share = F.array(*(F.lit(float(v / model.trace) if model.trace else None).cast("double") for v in model.values[:COMPONENTS]))
    return found.select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation_digits").try_cast("long").alias("deviation"),
        "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"), "deviation_digits",
    )

"""Row-wise Arrow mapping and written intermediate tables."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_DIR = "spark.checkpoint.dir"
PIECE_BYTES = 2 << 20
_LOCAL_DEFAULT = "file:///tmp/tabulary-checkpoints"


def held_until_done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last one the worker's free memory goes back to the system.

    Workers outlive tasks and stages, and what their allocators keep adds up beside
    the memory of the tasks that run then.
    """
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def add_columns(df: DataFrame, ddl: str, make: Callable[[pa.RecordBatch], dict], drop: tuple[str, ...] = (),
                piece: int = PIECE_BYTES) -> DataFrame:
    """Append the columns of ``ddl`` that ``make`` computes for each Arrow batch.

    A column of ``df`` with the name of a new column, or listed in ``drop``, is
    left out of the result. Batches are cut into pieces of about ``piece`` bytes, so that
    what a task holds stays small. The rows keep their partitions; nothing is shuffled.
    """
    new = T._parse_datatype_string(ddl)
    gone = {f.name.lower() for f in new} | {c.lower() for c in drop}
    schema = T.StructType([f for f in df.schema if f.name.lower() not in gone] + list(new))
    names = schema.names
    first = len(names) - len(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held_until_done(batches):
            rows = max(1, batch.num_rows * piece // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = make(part)
                columns = [part.column(part.schema.get_field_index(n)) for n in names[:first]]
                yield pa.RecordBatch.from_arrays(columns + [made[n] for n in names[first:]], names=names)

    return df.mapInArrow(run, schema)


def apart(docs: DataFrame, names: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of ``docs`` after ``stage``; those named like one of ``names``, which the
    stage makes for itself, come through unchanged."""
    moved = {c: f"__{c}_of_input" for c in docs.columns if c.lower() in names}
    done = stage(docs.withColumnsRenamed(moved))
    return done.select(*(F.col(moved.get(c, c)).alias(c) for c in docs.columns))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it; a local
    master may leave it unnamed."""
    path = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not path and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all nodes share")
    return (path or _LOCAL_DEFAULT).rstrip("/")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    A lost executor costs only the tasks that it ran. Tables live in a folder
    named after the application, so ``forget`` can remove them all.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tabulary-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget(spark: SparkSession) -> None:
    """Delete the tables that this application has written to the shared folder; results that are
    still to be read must be stored elsewhere first."""
    remove(spark, f"{shared_dir(spark)}/tabulary-{spark.sparkContext.applicationId}")

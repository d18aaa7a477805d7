"""Tables that are derived from others once and then read, such as folded texts and postings.

They lie below ``spark.checkpoint.dir`` (a local master: a temporary folder), named after
the files they were made of: a table whose files have changed gets a new derived one, and
a later application finds what an earlier one has stored. A table is written beside its
place and moved there when it is whole. ``forget`` removes them all.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL = "file:///tmp/tabulary-checkpoints"
#: To be raised when what a derived table holds changes.
_FORM = 6


def _files(rows: DataFrame) -> str:
    """A name for the state of a table's files, from their paths, sizes and times."""
    m = "_metadata"
    one = rows.select(F.xxhash64(F.col(f"{m}.file_path"), F.col(f"{m}.file_size"), F.col(f"{m}.file_modification_time")).alias("h")).distinct()
    found = one.agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    return f"{found.n}-{found.s or 0}".replace("--", "-m")


def _folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    return f"{(folder or _LOCAL).rstrip('/')}/tabulary-derived-{_FORM}"


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def derived(spark: SparkSession, name: str, rows: DataFrame, make: Callable[[DataFrame], DataFrame], by: str | None = None) -> DataFrame:
    """``make(rows)``, written on first use, in a folder for each value of column ``by``, and read from then on."""
    path = f"{_folder(spark)}/{name}-{_files(rows)}"
    place, files = _at(spark, path)
    table = make(rows)
    if not files.exists(place):
        made = f"{path}-{uuid.uuid4().hex}"
        out = table.write
        (out.partitionBy(by) if by else out).parquet(made, compression="zstd")
        if not files.rename(_at(spark, made)[0], place) and not files.exists(place):
            raise OSError(f"{made} can't be moved to {path}")
    return spark.read.schema(table.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for this application, that ``forget`` removes too."""
    return f"{_folder(spark)}/kept-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df``, written for this application and read back: lineage ends there, and its partitions stay as they are."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Remove all derived tables."""
    place, files = _at(spark, _folder(spark))
    files.delete(place, True)

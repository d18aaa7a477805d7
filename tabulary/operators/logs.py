"""Append-only logs, versioned tables, and who may see what."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "run_id string, kind string, target_year int, started_at timestamp, finished_at timestamp, status string, issues_seen int, issues_new int, records_new int, errors array<struct<issue:string,message:string>>"
SEARCH = "query string, result_count long, created_at timestamp"


def log_run(spark: SparkSession, folder: str, run: dict) -> None:
    """Append one run; it failed if it has errors and says nothing else."""
    row = {"errors": [], **run}
    row.setdefault("status", "failed" if row["errors"] else "ok")
    names = [f.split()[0] for f in RUN.split(", ")]
    spark.createDataFrame([tuple(row.get(n) for n in names)], RUN).write.mode("append").parquet(folder)


def log_searches(searches: DataFrame, folder: str) -> None:
    """Append searches; blank ones are not logged."""
    searches.where(F.trim("query") != "").select([f.split()[0] for f in SEARCH.split(", ")]).write.mode("append").parquet(folder)


def replace_table(spark: SparkSession, folder: str, make: Callable[[DataFrame], DataFrame]) -> int:
    """Write the next version of the table in ``folder``/v=<n>; readers take the highest that is complete.

    A version counts once its ``_SUCCESS`` stands there, so a job that dies half-way
    changes nothing.
    """
    now = latest_version(spark, folder)
    make(spark.read.parquet(f"{folder}/v={now}")).write.mode("overwrite").parquet(f"{folder}/v={now + 1}")
    return now + 1


def latest_version(spark: SparkSession, folder: str) -> int:
    """The highest complete version; an error if there is none."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [int(s.getPath().getName()[2:]) for s in files.listStatus(path) if s.getPath().getName()[:2] == "v=" and files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    if not found:
        raise ValueError(f"no complete version in {folder}")
    return max(found)


def visible_rows(rows: DataFrame, user: str | None, owner: str | None = None) -> DataFrame:
    """Rows that a reader may see: all of a public table, their own of an owned one, none without a user."""
    if owner is None:
        return rows
    return rows.where(F.col(owner) == user) if user is not None else rows.limit(0)


def first_source_with_rows(*sources: DataFrame) -> DataFrame:
    """The first source that has rows; an error if none has."""
    for rows in sources:
        if not rows.isEmpty():
            return rows
    raise ValueError("no source has rows")

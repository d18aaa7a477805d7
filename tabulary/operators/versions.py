"""Partitioned tables whose merges rewrite only the partitions that updates fall into.

A table lies in folders of buckets of its key, ``bucket=<n>/v=<version>``, and a log names for
each version the buckets that it wrote. The table as of a version is, for each bucket, the
last of its folders up to that version; nothing is changed in place, so readers of
an earlier version are never disturbed and a job that dies leaves no trace: its
folders are named by no log entry. A log entry is one small file, put in its place
by a rename once all its buckets are written. A version that is written again after
a failure replaces its own folders only.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.operators.merge import merge

BUCKETS = 64


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def log(spark: SparkSession, target: str) -> dict[int, list[int]]:
    """The buckets that each version wrote."""
    at, files = _files(spark, f"{target}/_log")
    if not files.exists(at):
        return {}
    names = [s.getPath().getName() for s in files.listStatus(at)]
    rows = spark.read.text([f"{target}/_log/{n}" for n in names if n.endswith(".json")], wholetext=True).collect() if any(n.endswith(".json") for n in names) else []
    return {e["version"]: e["buckets"] for e in (json.loads(r.value) for r in rows)}


def _commit(spark: SparkSession, target: str, version: int, buckets: list[int]) -> None:
    name = f"{target}/_log/{version:012d}"
    made, files = _files(spark, f"{name}-{uuid.uuid4().hex}.tmp")
    out = files.create(made, True)
    out.write(bytearray(json.dumps({"version": version, "buckets": sorted(buckets)}).encode()))
    out.close()
    final = _files(spark, f"{name}.json")[0]
    if files.exists(final):
        files.delete(final, False)
    if not files.rename(made, final):
        raise OSError(f"{made} can't be moved to {final}")


def _folders(written: dict[int, list[int]], version: int | None = None) -> dict[int, int]:
    """The last version of each bucket."""
    return {b: v for v in sorted(written) if version is None or v <= version for b in written[v]}


def table(spark: SparkSession, target: str, schema, version: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The table as of a version (the last one), or some of its buckets; without any folder an empty table."""
    at = {b: v for b, v in _folders(log(spark, target), version).items() if only is None or b in only}
    paths = [f"{target}/bucket={b}/v={v}" for b, v in sorted(at.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def write(rows: DataFrame, target: str, keys: list[str], version: int, buckets: int = BUCKETS) -> list[int]:
    """Write rows as the given version of the buckets they fall into, and log it."""
    spark = rows.sparkSession
    made = f"{target}/_made-{version}-{uuid.uuid4().hex}"
    rows.withColumn("bucket", bucket_of(keys, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(made)
    at, files = _files(spark, made)
    touched = []
    for status in files.listStatus(at):
        name = status.getPath().getName()
        if not name.startswith("bucket="):
            continue
        final = _files(spark, f"{target}/{name}/v={version}")[0]
        files.delete(final, True)
        files.mkdirs(final.getParent())
        if not files.rename(status.getPath(), final):
            raise OSError(f"{status.getPath()} can't be moved to {final}")
        touched.append(int(name.removeprefix("bucket=")))
    files.delete(at, True)
    _commit(spark, target, version, touched)
    return touched


def merge_into(target: str, updates: DataFrame, schema, keys: list[str], policy: dict[str, str], version: int, order: str | None = None, buckets: int = BUCKETS) -> list[int]:
    """Merge ``updates`` (see ``merge``) as a new version and return the buckets that were rewritten.

    Only buckets that some update falls into are read and written; updates that change nothing
    in a bucket leave it as it is. Numbers of buckets that fit a table stay with it.
    """
    spark = updates.sparkSession
    touched = [r.b for r in updates.select(bucket_of(keys, buckets).alias("b")).distinct().collect()]
    if not touched:
        return []
    old = table(spark, target, schema, version - 1, touched)
    done = merge(old, updates, keys, policy, order)
    names = [c for c in done.columns if c != "__inserted"]
    before = old.select(bucket_of(keys, buckets).alias("b"), F.xxhash64(*names).alias("h")).groupBy("b").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))
    after = done.select(bucket_of(keys, buckets).alias("b"), F.xxhash64(*names).alias("h")).groupBy("b").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))
    changed = [r.b for r in after.join(before, ["b", "n", "s"], "left_anti").collect()]
    return write(done.select(*names).where(bucket_of(keys, buckets).isin(changed)), target, keys, version, buckets) if changed else []


def replace_in(target: str, rows: DataFrame, keys: list[str], version: int, buckets: int = BUCKETS) -> list[int]:
    """Put ``rows`` in the place of the whole table: buckets without rows become empty."""
    spark = rows.sparkSession
    touched = write(rows, target, keys, version, buckets)
    gone = sorted(set(_folders(log(spark, target), version - 1)) - set(touched))
    for b in gone:
        spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{target}/bucket={b}/v={version}")
    _commit(spark, target, version, touched + gone)
    return touched + gone


def forget_before(spark: SparkSession, target: str, version: int) -> int:
    """Remove folders that no version from ``version`` on reads; how many."""
    written = log(spark, target)
    kept = set(_folders(written, version).items()) | {(b, v) for v, bs in written.items() if v > version for b in bs}
    gone = [(b, v) for v, bs in written.items() for b in bs if (b, v) not in kept]
    for b, v in gone:
        at, files = _files(spark, f"{target}/bucket={b}/v={v}")
        files.delete(at, True)
    return len(gone)

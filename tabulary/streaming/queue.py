"""The ingest queue as a stream: issues arrive as files, due ones are handed on once.

There is no continuous state in the archive's work: a run takes what is there and
ends. ``available_now`` gives that as a streaming query, so the checkpoint
remembers which files were read; late corrections arrive as later files and are
merged by the handler.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tabulary.operators import versions


def available_now(spark: SparkSession, folder: str, schema: str, checkpoint: str, handle: Callable[[DataFrame, int], None], files: int = 100) -> StreamingQuery:
    """Read all new Parquet files of ``folder``, ``files`` at a time, and hand each batch to ``handle``."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merging_handler(spark: SparkSession, target: str, keys: list[str], policy: dict[str, str], order: str, buckets: int = versions.BUCKETS) -> Callable[[DataFrame, int], None]:
    """A handler that merges each batch into the versioned table ``target``, as version <batch> + 1.

    Only the buckets that a batch falls into are written. A batch that is handled again writes
    the same version again, so a restart neither loses nor doubles rows.
    """

    def handle(batch: DataFrame, number: int) -> None:
        schema = batch.select([c for c in batch.columns if c != order]).schema
        versions.merge_into(target, batch, schema, keys, policy, number + 1, order, buckets)

    return handle

"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as
Parquet and read again as the next one's docs. Documents that the quality
classifier rejects go; of each group of near-duplicates the document with the
least id stays; documents that share a passage with the benchmark go; personal
data is masked; what is left is encoded into pieces and decoded again. All
stages but the last give the columns of documents.

Defined results: a null or empty text is scored, grouped and encoded like any other and
goes where its score or its group sends it; rows with equal ids are told apart by their
texts, and equal rows are copies of which one stays; very long texts go through whole;
columns of other names come through unchanged, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tabulary.llm import decontam, pieces, pii, quality, simhash
from tabulary.llm.arrowmap import remove, shared_dir

STAGES = [
    ("quality", quality.keep_stage),
    ("near_duplicates", simhash.one_of_each_stage),
    ("decontamination", decontam.clean_stage),
    ("personal_data", pii.mask_stage),
    ("pieces", pieces.encode_stage),
]

#: No stage but the third can be said in SQL: the classifier is trained, the fingerprints,
#: the random field and the pieces have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``sf_dir``'s documents; a stage is written to the shared folder, and goes when the next one is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/tabulary-{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)

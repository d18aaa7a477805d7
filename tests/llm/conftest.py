import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [f"w{i}" for i in range(400)]


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def rows():
    """Texts with nulls, blanks, copies, near copies, shared passages, long texts and repeated rows."""
    rng = random.Random(7)
    shared = sentence(rng, 60)
    base = sentence(rng, 200)
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "two words"), (5, base), (6, base), (7, base.replace("w1 ", "w2 ", 1)), (None, base), (None, None)]
    out += [(10 + i, f"{sentence(rng, 30)} {shared} {sentence(rng, 30)}") for i in range(12)]
    out += [(30, "la " * 120), (31, "LA  la\nLA " * 50), (32, sentence(rng, 6000)), (33, "é ü 日本 \U0001f600 " * 40), (34, sentence(rng, 34)), (35, sentence(rng, 35))]
    out += [(36, "same\nsame\n\nsame # * |\n" + sentence(rng, 60)), (5, base)]
    out += [(40 + i, sentence(rng, 120)) for i in range(25)]
    return [(d, t, None if i % 9 == 4 else "en", None if i % 7 == 3 else f"src{i % 3}", None if t is None else len(t)) for i, (d, t) in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def pairs():
    return [(d, t) for d, t, *_ in rows()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder(spark, docs, tmp_path_factory):
    """A folder of tables with extra columns whose names clash with outputs."""
    from pyspark.sql import functions as F

    at = str(tmp_path_factory.mktemp("tables"))
    docs.withColumns({"n_words": F.lit("x"), "score": F.lit(1), "hits": F.lit("y"), "ids": F.lit(2), "fp": F.lit("z"), "spans": F.lit(0)}).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, rows()[5][1]), (2, "W3 w4"), (3, None), (4, ""), (None, "x")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    labels = [(d, int(d % 4 != 0), 0) for d, *_ in rows() if d is not None] + [(None, 1, 0), (999, 0, 0), (41, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at

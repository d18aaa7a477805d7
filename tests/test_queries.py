"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import datetime
import decimal
import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tabulary.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    found = registry.queries()[name](spark, FOLDER)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found.columns, found.collect()) == rows(want.columns, want.fetchall())


def test_snippets_of_long_texts(spark, tmp_path):
    far = "word " * 8000
    spark.createDataFrame([(1, f"{far} the end is near"), (2, f"the {far} The, this -- (is) {far}"), (3, f"{far} the")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = dict(registry.queries()["snippets"](spark, str(tmp_path)).collect())
    assert found == dict(duckdb.sql(registry.oracle_sql()["snippets"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall())
    assert found[1].endswith(" word <the> end <is> near") and " <The,> this <(is)> word " in found[2] and 3 not in found


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    found = registry.queries()[name](spark, FOLDER)
    assert len(found.collect()) > 0 or name in ("deadlines", "text_records")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())
    if importlib.util.find_spec("tabulary.llm") is None or importlib.util.find_spec("corpus_pipeline") is None:
        assert set(registry.queries()) == set(entry.queries())

import pytest
from pyspark.sql import functions as F

from tabulary.operators import lists as L
from tabulary.operators import merge as M
from tabulary.operators import versions as V


def test_merge_policies(spark):
    old = spark.createDataFrame([(1, "a", None, False), (2, "b", "x", True)], "k int, v string, w string, f boolean")
    new = spark.createDataFrame([(1, "c", "y", True, 1), (1, "d", None, False, 2), (3, "e", "z", False, 1)], "k int, v string, w string, f boolean, n int")
    got = M.merge(old, new, ["k"], {"v": "new", "w": "prefer_new", "f": "either"}, "n").orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "d", "y", True, False), (2, "b", "x", True, False), (3, "e", "z", False, True)]
    kept = M.merge(old, new, ["k"], {}, "n").orderBy("k").collect()
    assert [r.v for r in kept] == ["a", "b", "e"]
    with pytest.raises(ValueError):
        M.merge(old, new, ["k"], {"v": "odd"})


def test_insert_ignore_and_changed(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    more = spark.createDataFrame([(1, "b"), (2, "d"), (2, "c")], "k int, v string")
    assert sorted(tuple(r) for r in M.insert_ignore(old, more, ["k"], "v").collect()) == [(1, "a"), (2, "c")]
    a = spark.createDataFrame([(1, ["x", "y"]), (2, ["x"])], "k int, s array<string>")
    b = spark.createDataFrame([(1, ["y", "x", "x"]), (2, ["z"]), (3, [])], "k int, s array<string>")
    assert [r.k for r in M.changed(a, b, "k", "s").collect()] == [2]


def test_earlier_match_and_adjacent(spark):
    late = spark.createDataFrame([(10, "a", 5), (11, "b", 1)], "id int, key string, day int")
    early = spark.createDataFrame([(1, "a", 3), (2, "a", 4), (3, "a", 5), (4, "b", 2)], "id int, key string, day int")
    got = L.earlier_match(late, early, ["key"], "day", "id").orderBy("id").collect()
    assert [(r.id, r.source_id) for r in got] == [(10, 2), (11, None)]
    issues = spark.createDataFrame([(2024, 9), (2025, 1), (2025, 3)], "year int, number int")
    assert {tuple(r) for r in L.adjacent(issues, ["year", "number"], [2025, 1]).collect()} == {(2024, 9, "prev"), (2025, 3, "next")}


def test_ending_like_and_order(spark):
    rows = spark.createDataFrame([(1, "A-LONG COMMON ENDING OF A TITLE"), (2, "B LONG COMMON ENDING OF A TITLE"), (3, "C")], "id int, t string")
    assert {r.id for r in L.ending_like(rows, "t", "Z-LONG COMMON ENDING OF A TITLE").collect()} == {1, 2}
    assert L.ending_like(rows, "t", "A-SHORT").count() == 0
    assert [r.id for r in L.in_list_order(rows, "id", [3, 9, 1]).collect()] == [3, 1]


def test_queue(spark):
    rows = spark.createDataFrame([(1, "pending", 0, "2025-01-01"), (2, "failed", 1, "2025-01-01"), (3, "failed", 3, "2025-01-01"), (4, "failed", 1, "2025-05-30"), (5, "ok", 0, "2025-01-01")], "id int, status string, tries int, day string")
    queue = M.work_queue(rows.withColumn("day", F.to_date("day")), "status", "tries", "day", F.lit("2025-06-01").cast("date"), [F.desc("id")])
    assert [r.id for r in queue.collect()] == [2, 1]


def test_versions_write_what_changed(spark, tmp_path):
    at, schema = f"{tmp_path}/t", "k int, v string, w string"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    first = V.merge_into(at, spark.range(500).select(F.col("id").cast("int").alias("k"), F.lit("a").alias("v"), F.lit(None).cast("string").alias("w")), schema, ["k"], {}, 1, buckets=16)
    before = files()
    assert sorted(first) == list(range(16)) and V.table(spark, at, schema).count() == 500
    two = V.merge_into(at, rows((3, "b", "x"), (900, "n", None)), schema, ["k"], {"v": "new", "w": "prefer_new"}, 2, buckets=16)
    assert 1 <= len(two) <= 2 and all(files()[p] == t for p, t in before.items())
    now = {r.k: (r.v, r.w) for r in V.table(spark, at, schema).collect()}
    assert len(now) == 501 and now[3] == ("b", "x") and now[900] == ("n", None) and now[4] == ("a", None)
    # An update that changes nothing writes nothing; the same version again gives the same table.
    assert V.merge_into(at, rows((3, "b", "x")), schema, ["k"], {"v": "new"}, 3, buckets=16) == []
    assert V.merge_into(at, rows().limit(0), schema, ["k"], {}, 3, buckets=16) == []
    assert sorted(V.merge_into(at, rows((3, "b", "x"), (900, "n", None)), schema, ["k"], {"v": "new", "w": "prefer_new"}, 2, buckets=16)) == sorted(two)
    assert {r.k: (r.v, r.w) for r in V.table(spark, at, schema).collect()} == now
    assert V.table(spark, at, schema, 1).count() == 500 and V.table(spark, at, schema, 0).count() == 0
    V.replace_in(at, rows((1, "z", None)), ["k"], 4, buckets=16)
    assert [tuple(r) for r in V.table(spark, at, schema).collect()] == [(1, "z", None)] and V.table(spark, at, schema, 2).count() == 501
    assert V.forget_before(spark, at, 4) == 16 + len(two) and V.table(spark, at, schema).count() == 1

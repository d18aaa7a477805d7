import datetime

from pyspark.sql import functions as F

from tabulary.operators import feeds, versions
from tabulary.sources import pages as P
from tabulary.streaming import queue


def test_archive_page(spark):
    html = """<table><tr><th>SAYI</th></tr><tr><td>12</td><td>31.12.2025</td><td><a href="/Portals/1/12.pdf">x</a></td></tr>
    <tr><td>Sayı 13</td><td>5 Ağustos 2025</td><td><a href='y/13.pdf'>x</a></td></tr><tr><td>14</td><td>31.02.2025</td><td><a href="z">x</a></td></tr><tr><td>15</td><td>1.1.2025</td><td>none</td></tr></table>"""
    got = P.archive_issues(spark.createDataFrame([(2025, html), (2024, None)], "year int, html string"), "html", "year").orderBy("number").collect()
    assert [tuple(r) for r in got] == [(2025, 12, datetime.date(2025, 12, 31), "/Portals/1/12.pdf"), (2025, 13, datetime.date(2025, 8, 5), "y/13.pdf")]
    url = P.absolute_url(F.col("h"), "https://a.example", "https://b.example/list/")
    rows = spark.createDataFrame([("/Portals/1.pdf",), ("x.pdf",), ("https://c.example/z",)], "h string").select(url.alias("u")).collect()
    assert [r.u for r in rows] == ["https://a.example/Portals/1.pdf", "https://b.example/list/x.pdf", "https://c.example/z"]


def test_listing(spark):
    html = '<table><tr><td>MİA.1/2025</td><td>Daire</td><td><a href="a.pdf">PDF</a></td></tr><tr><td>no link</td></tr></table>'
    got = P.circular_listing(spark.createDataFrame([(1, html)], "k int, html string"), ["k"], "html").collect()
    assert [(r.pdf_href, r.cells[1]) for r in got] == [("a.pdf", "Daire")]


def test_feeds(spark):
    rows = spark.createDataFrame([(i, f"s{i}", f"T<{i}>", None, datetime.date(2025, 1, 1 + i), True) for i in range(5)], "id int, slug string, title string, summary string, published_at date, has_own_page boolean")
    items = feeds.rss_items(rows, "https://a.example/", 2).orderBy(F.desc("position")).collect()
    assert len(items) == 2 and items[0]["item"].startswith("<item><title>T&lt;4&gt;</title><link>https://a.example/s4</link>")
    chunks = feeds.sitemap(rows, F.col("slug"), F.col("published_at"), F.lit(0.5), [F.desc("published_at")], size=2).collect()
    assert sorted((r.chunk, r["loc"]) for r in chunks) == [(0, "s3"), (0, "s4"), (1, "s1"), (1, "s2"), (2, "s0")]
    assert feeds.recent_chunk(rows, F.lit("2025-07-03").cast("date")).count() == 2


def test_queue_merges_each_file_once(spark, tmp_path):
    folder, target = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int").coalesce(1).write.parquet(f"{folder}/1")
    schema = "k int, v string, n int"
    handle = queue.merging_handler(spark, target, ["k"], {"v": "prefer_new"}, "n")
    for more in (None, [(2, "c", 2), (3, None, 2)]):
        if more:
            spark.createDataFrame(more, schema).coalesce(1).write.parquet(f"{folder}/2")
        queue.available_now(spark, f"{folder}/*", schema, f"{tmp_path}/check", handle).awaitTermination()
    last = versions.table(spark, target, "k int, v string").orderBy("k").collect()
    assert [tuple(r) for r in last] == [(1, "a"), (2, "c"), (3, None)]

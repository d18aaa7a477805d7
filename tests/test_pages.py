import datetime
import random

from pyspark.sql import functions as F

from tabulary.functions import labels, params
from tabulary.operators import lists as L
from tabulary.operators import pages as P
from tabulary.sources import pages as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_page_window(spark):
    window = lambda page, total: one(spark, P.page_window(F.lit(page), F.lit(total)))
    assert window(1, 0) == [] and window(3, 7) == [1, 2, 3, 4, 5, 6, 7]
    assert window(1, 20) == [1, 2, None, 20] and window(10, 20) == [1, None, 9, 10, 11, None, 20] and window(19, 20) == [1, None, 18, 19, 20]


def test_numbers_as_typed(spark):
    got = {x: one(spark, labels.canonical_number(F.lit(x))) for x in ("12.345,678", "1,2,3", "12,", "", "abc", ",5")}
    assert got == {"12.345,678": "12345.67", "1,2,3": "12.3", "12,": "12.", "": "", "abc": "", ",5": ".5"}
    assert [one(spark, labels.number_input(F.lit(x))) for x in ("12345.67", "999", "1234567", "12.", "")] == ["12.345,67", "999", "1.234.567", "12,", ""]


def test_topic_parameters():
    got = params.parse_topic({"tur": ["tuzuk", "yasa"], "yayinci": "khk", "ilan": "x", "baslangic": "2024-13-1", "sirala": ["eski", "yeni"]})
    assert got == {"baslangic": None, "bitis": None, "tur": ["tuzuk", "yasa"], "yayinci": "khk", "ilan": None, "sirala": "eski"}
    assert params.parse_topic(None)["sirala"] == "yeni"


def test_letterhead(spark):
    assert one(spark, labels.letterhead_date(F.lit("a\nSayı : KHK.0.00-001/07-26/E.5154   6 Ekim 2026\n7 Mart 1999"))) == "2026-10-06"
    assert one(spark, labels.letterhead_date(F.lit("\n" * 30 + "6 Ekim 2026"))) is None and one(spark, labels.letterhead_date(F.lit(None).cast("string"))) is None


def test_addresses_and_amendments(spark):
    at = lambda own, year, label: one(spark, P.record_address(F.lit(own), F.lit("s"), F.lit(year).cast("int"), F.lit(4), F.lit(label)))
    assert [at(True, 2020, "A.E. 1"), at(False, 2020, "A.E. 1"), at(False, None, None), at(False, 2020, None)] == ["/karar/s", "/sayilar/2020/4#karar-A.E.%201", "/karar/s", "/sayilar/2020/4"]
    assert [one(spark, P.amends(F.lit(x))) for x in ("KARAR TADİL EDİLMESİ", "İPTAL  EDİLEN", "iptal edildi", "İPTALED", "TADİLAT", "tadİl\u00a0edilmesi")] == [True, True, False, False, False, True]
    assert [one(spark, P.contains_text(F.lit(x), "5%_\\")) for x in ("a 5%_\\ b", "a 5x_y b")] == [True, False]


def test_unnested_gives_nulls(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], [5])], "k int, x array<string>, y array<int>")
    assert [tuple(r) for r in P.unnested(rows, ["k"], ["x", "y"]).collect()] == [(1, "a", 5), (1, "b", None)]


def test_queue_marks_all_that_was_read(spark):
    day = datetime.date(2025, 1, 1)
    issues = spark.createDataFrame([(i, day + datetime.timedelta(i), None if i else day) for i in range(9)], "id int, published_at date, read_at date")
    queue = P.reading_queue(issues, "read_at")
    assert [r.id for r in queue.collect()] == [8, 7, 6, 5, 4]
    assert {r.id for r in P.mark_read(issues, queue, "read_at", F.lit(day)).where("read_at is null").collect()} == {1, 2, 3}


def test_links_and_fixtures(spark, tmp_path):
    page = spark.createDataFrame([(1, '<a href="/a/x.PDF">x</a><a HREF=\'/a/x.PDF\'></a><a href="/b/y.pdf"></a><a href="/a/z.doc"></a>')], "k int, html string")
    assert [r.link for r in S.linked_files(page, ["k"], "html", "/a/").collect()] == ["/a/x.PDF"]
    assert one(spark, S.archive_address("https://a.example/", F.lit(2024))) == "https://a.example/AR%C5%9E%C4%B0V/2024"
    (tmp_path / "2025-261.txt").write_text("EK III\nbir\n")
    (tmp_path / "notes.txt").write_text("x")
    assert [tuple(r) for r in S.text_fixtures(spark, str(tmp_path)).collect()] == [(2025, 261, "EK III\nbir\n")]
    (tmp_path / "MT.1-2025.md").write_text("# a\n")
    (tmp_path / "MT.1-2025.json").write_text('{\n"title": "t"}')
    assert [(r.label, r.text, r.title) for r in S.circular_fixtures(spark, str(tmp_path)).collect()] == [("MT.1-2025", "# a\n", "t")]


def test_exchange_rates(spark):
    cell = lambda *c: "<tr class='x'>" + "".join(f"<td align='r'> {x} </td>" for x in c) + "</tr>"
    html = "01/02/2025 - Tarihinde Geçerli Olan Resmi Kurlar <table id='edit-resmi-kur-table'>" + cell("1 Amerikan Doları (USD)", "41.1", "41.5", "41", "41.6") + cell("100 Japon Yeni (JPY)", "28", "28.1", "", "-") + cell("1 x (CHF)", 1, 2, 3, 4) + "</table><table>" + cell("1 Euro (EUR)", 1, 2, 3, 4) + "</table>"
    rows = spark.createDataFrame([(1, html), (2, html.replace("Resmi", "")), (3, None)], "k int, html string")
    assert {tuple(r) for r in S.exchange_rates(rows, ["k"], "html").collect()} == {(1, "01/02/2025", "USD", 41.5, 41.6), (1, "01/02/2025", "JPY", 0.281, None)}


def test_numbers_follow_the_order(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, None])) for i in range(5000)]
    df = spark.createDataFrame(rows, "id int, day int").repartition(7)
    got = {r.id: r.place for r in L.numbered(df, [F.desc("day"), F.desc("id")], "place").collect()}
    want = sorted(rows, key=lambda r: (-(r[1] or 0), -r[0]))
    assert got == {i: k for k, (i, _) in enumerate(want)}
    assert L.numbered(df.limit(0), [F.desc("id")], "place").count() == 0


def test_bodies_under_the_limit(spark):
    df = spark.createDataFrame([("a" * 9, None), ("a" * 10, "b"), (None, "b" * 10), (None, None)], "x string, y string")
    assert [r[0] for r in df.select(P.body_guard(["x", "y"], 10)).collect()] == [True, False, False, True]


def test_amendments_equal_a_plain_reading(spark):
    """Ends within longer ends, ids that are their own best, dates shared by many; no join of records with records."""
    rng = random.Random(4)
    ends = ["abcd", "zabcd", "abcd yyy", "yzabcd", "ab-cd", "zab-cd"]
    rows = [(i, "tuzuk" if rng.random() < 0.9 else "x", rng.random() < 0.7, rng.choice(["q-", "", "r"]) + rng.choice(ends), None if rng.random() < 0.05 else datetime.date(2000, 1, rng.choice(range(1, 20)))) for i in range(150)]
    df = spark.createDataFrame([*rows, (200, "tuzuk", True, None, datetime.date(2000, 1, 1))], "id int, doc_type string, has_own_page boolean, title_normalized string, published_at date")
    found = P.other_amendments(df, df, 2)
    want = set()
    for i, kind, _, title, date in rows:
        end = title.split("-")[-1]
        best = {}
        for j, k, own, t, d in rows:
            if kind == k == "tuzuk" and own and len(end) > 2 and t.endswith(end) and j != i and d and date and d != date:
                best[d] = max(j, best.get(d, -1))
        want |= {(i, best[d], d) for d in sorted(best, reverse=True)[:8]}
    assert {tuple(r) for r in found.collect()} == want and len(want) > 500
    same = spark.createDataFrame([(i, "tuzuk", True, "x-bir tuzuk", datetime.date(2000, 1, 1 + i % 28)) for i in range(1000)], "id int, doc_type string, has_own_page boolean, title_normalized string, published_at date")
    made = P.other_amendments(same, same, 3)
    assert made.count() == 8000 and "endswith" not in made._jdf.queryExecution().executedPlan().toString().lower()

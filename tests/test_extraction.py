from pyspark.sql import functions as F

from tabulary.functions import extraction as E
from tabulary.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_glyphs(spark):
    text = F.lit("a(cid:100)(cid:36)b(cid:999)(cid:x)")
    assert one(spark, E.decode_glyphs(text)) == "aÇAb(cid:x)" and one(spark, E.count_glyphs(text)) == 3
    assert one(spark, E.decode_glyphs(F.lit(""))) == ""


def test_tables(spark):
    good = "x <table><tr><td>A</td><td>B</td></tr><tr><td>1</td><td>2</td></tr></table> y"
    r = one(spark, E.repair_all_tables(F.lit(good)))
    assert r.text == "x | A | B |\n| --- | --- |\n| 1 | 2 | y" and not r.needs_review
    ragged = "<table><tr><td>A</td><td>B</td></tr><tr><tr>1<td>2</td><td>3</td></tr></table>"
    r = one(spark, E.repair_all_tables(F.lit(ragged)))
    assert r.needs_review and r.text.endswith("| 1 | 2 | 3 |")
    assert tuple(one(spark, E.repair_all_tables(F.lit("<table></table>")))) == ("<table></table>", True)
    assert tuple(one(spark, E.repair_all_tables(F.lit("none")))) == ("none", False)


def test_law_blocks(spark):
    text = "BİRİNCİ KISIM\nBu Yasa, Kuzey Kıbrıs sınırları içinde kurulan tüm derneklere\nve üst kuruluşlarına uygulanır.\n(2) Bu fıkra ikinci fıkradır\n\nKısa İsim\nBU BİR CÜMLEDİR."
    assert [tuple(b) for b in one(spark, E.law_blocks(F.lit(text)))] == [
        ("heading", "BİRİNCİ KISIM"), ("paragraph", "Bu Yasa, Kuzey Kıbrıs sınırları içinde kurulan tüm derneklere ve üst kuruluşlarına uygulanır."),
        ("paragraph", "(2) Bu fıkra ikinci fıkradır"), ("paragraph", "Kısa İsim"), ("paragraph", "BU BİR CÜMLEDİR."),
    ]
    assert one(spark, E.law_blocks(F.lit("  \n\n "))) == []


def test_status(spark):
    lit, none = F.lit, F.lit(None).cast("int")
    assert one(spark, E.looks_scanned(lit("x" * 100), lit(1), lit(10))) and not one(spark, E.looks_scanned(lit("x" * 100), none, lit(1000)))
    bad, better = "ÜRETiM kelime " * 3, "ÜRETİM kelime " * 3
    assert one(spark, E.keep_rereading(lit(bad), lit(better))) and not one(spark, E.keep_rereading(lit(bad), lit("ÜRETİM")))
    no = lit(False)
    got = [one(spark, E.extraction_status(lit(t), s, no)) for t, s in ((" ", no), ("xqw " * 30, no), ("güzel bir deneme " * 20, lit(True)), ("kısa", no))]
    assert got == ["failed", "needs_review", "ocr", "extracted"]


def test_strip_html(spark):
    assert one(spark, T.strip_html(F.lit("a<BR/>b<p>c</p>d&nbsp;&amp;lt;"))) == "a\nb c\nd <"

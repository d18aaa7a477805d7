import datetime
import random

from pyspark.sql import functions as F

from tabulary.functions import classify as K
from tabulary.functions import gazette as G

HTML = """<table><tr><td>MAİN</td><td></td><td>ATAMA KARARNAMESİ ÜÇLÜ</td><td></td></tr>
<tr><td>EK  III</td><td>A.E.1.071</td><td>REKABET KURULU KARARI - KARAR SAYISI:318/2025 KONU: Bir ihale</td><td>x</td></tr>
<tr><td></td><td>A.E. 1072</td><td></td></tr>
<tr><td>EK VI</td><td></td><td>BİR YASA TASARISI (Y.T.NO:2/3/2025)</td></tr>
<tr><td></td><td>GENELGE MİA.17/2025</td><td>DÜZELTME: MÜNHAL İLANI</td></tr><tr><td>&nbsp;</td></tr></table>"""


def test_contents_table(spark):
    df = spark.createDataFrame([(1, HTML), (2, "<p>none</p>"), (3, None)], "issue int, html string")
    got = [tuple(r) for r in G.parse_contents_table(df, ["issue"], "html").orderBy("ordinal").select("section", "ref_type", "ref_number", "title", "subject", "is_correction").collect()]
    assert got == [
        ("MAIN", None, None, "ATAMA KARARNAMESİ ÜÇLÜ", None, False),
        ("EK_III", "ae", "1071", "REKABET KURULU KARARI - KARAR SAYISI:318/2025 KONU: Bir ihale", "Bir ihale", False),
        ("EK_III", "ae", "1072", "A.E. 1072", None, False),
        ("EK_VI", "yt", "2/3/2025", "BİR YASA TASARISI (Y.T.NO:2/3/2025)", None, False),
        ("EK_VI", "mia", "17/2025", "DÜZELTME: MÜNHAL İLANI", None, True),
    ]


def test_contents_text(spark):
    text = "EK V BÖLÜM I:\nŞ.M. 12 BİR LTD Ş.M. 13 İKİ LTD\nEK IV BÖLÜMI\nDÜZELTME: Ü(K-II) 4-2025 KARAR\nMAIN\nReferanssız satır\nkısa"
    got = G.parse_contents_text(spark.createDataFrame([(1, text)], "k int, html string"), ["k"], "html").orderBy("ordinal")
    assert [tuple(r) for r in got.select("section", "ref_type", "ref_number", "title", "is_correction").collect()] == [
        ("EK_V_B_I", "sm", "12", "Ş.M. 12 BİR LTD", False), ("EK_V_B_I", "sm", "13", "Ş.M. 13 İKİ LTD", False),
        ("EK_IV_B_I", "ukii", "4-2025", "DÜZELTME: Ü(K-II) 4-2025 KARAR", True), ("MAIN", None, None, "Referanssız satır", False),
    ]


def test_bodies(spark):
    text = "kapak\fSayı : 12\n" + "Uzun bir gövde metni. " * 5 + "\n\f45\nSayı : 13\nkısa"
    issues = spark.createDataFrame([(1, text)], "issue int, body_source string")
    records = spark.createDataFrame([(1, 0, "ae", "12"), (1, 1, "ae", "13"), (1, 2, None, None)], "issue int, ordinal int, ref_type string, ref_number string")
    got = G.extract_bodies(records, issues, "issue", "body_source").orderBy("ordinal").collect()
    assert got[0].body.startswith("Sayı : 12") and "13" not in got[0].body and got[0].page_from == 2
    assert got[1].body is None and got[1].page_from == 3 and got[2].page_from is None


def test_labels_equal_their_patterns():
    rng = random.Random(2)
    labels = ["Sayı : 1", "Sayı : 12", "KARAR NO: 3", "A.E. 12", "Ü(K-I) 7-2025", "SAYI: 5", "İ.S. 1", "1 1", "a", "A."]
    parts = [*labels, "SAYI:12", "sayi :1", "karar no:3", "A.E12", "AE 12", "Ü.(K-I)7-2025", "ü ( k - i ) 7 - 2025", "A. E. 1 2", "metin ", "\n", "\f", "3", ".", " ", "İS1", "ıs 1", "1 11", "1.1"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        want = {x: [m.start() for m in G._elastic(x).finditer(text)] for x in labels}
        assert G.label_places(text, labels) == want, text
    many = [f"Sayı : {i}" for i in range(3000)]
    text = "".join(f"{x}\nmetin metin\n" for x in many)
    assert all(len(v) == 1 for v in G.label_places(text, many).values())


def test_classification(spark):
    lit, none = F.lit, F.lit(None).cast("string")
    row = spark.range(1).select(
        K.doc_type(lit("Lefkoşa zorla mal iktisabı yasası"), lit("EK_III"), lit("ae")).alias("a"), K.doc_type(lit("AVUKATLAR YASASI - BARO SINAV NETİCELERİ"), lit("EK_III"), lit("ae")).alias("b"),
        K.doc_type(lit("BİR YASA"), lit("EK_III"), none).alias("c"), K.topics(lit("TERFİ ETTİRİLEN KİŞİLER"), lit("sinav_sonucu")).alias("d"),
        K.issuer(lit("MİA.17/2025"), lit("munhal_ilani"), none).alias("e"), K.issuer(lit("x"), lit("diger"), none).alias("f"), K.munhal_kind(lit("İLK ATANMA VE YÜKSELME"), none, lit("khk")).alias("g"),
    ).first()
    assert tuple(row) == ("kamulastirma", "sinav_sonucu", "diger", ["sinav-sonuclari"], "khk", None, "yukselme")


def test_deadlines():
    day = datetime.date
    assert G.deadline_in("Başvurular 11-25 Haziran 2025 tarihleri arasında. Yazılı sınav 3 Temmuz 2025, altı kadro") == (day(2025, 6, 25), "Yazılı sınav 3 Temmuz 2025, altı kadro")
    assert G.deadline_in("Son başvuru 26.01.2026 günüdür") == (day(2026, 1, 26), None)
    assert G.deadline_in("Son başvuru 26.01.2026 ya da 27.01.2026") == (None, None)
    assert G.deadline_in("31.02.2026 son başvuru") == (None, None) and G.deadline_in(None) == (None, None)
    assert G.deadline_in("29 Eylül 2026 - 3 Ocak 2027 arasında")[0] == day(2027, 1, 3)


def test_entities_and_aliases(spark):
    row = spark.range(1).select(
        G.entities(F.lit("VADİLİ GIDA SANAYİ LTD LEFKE YOLU"), F.lit("Bakanlar  Kurulu kararı Lefkoşa")).alias("e"), G.reference_aliases(F.lit("uki"), F.lit("12-2025")).alias("a"),
        G.reference_aliases(F.lit("rekabet"), F.lit("12")).alias("b"), G.review_flags(F.lit("yasa"), F.lit(""), F.lit(None).cast("string")).alias("f"),
    ).first()
    assert {(e.kind, e.slug, e.confidence) for e in row.e} == {
        ("institution", "bakanlar-kurulu", 0.7), ("place", "lefkosa", 0.7), ("place", "vadili", 1.0), ("place", "lefke", 1.0), ("company", "vadili-gida-sanayi-ltd", 1.0)}
    assert row.a == ["UKI 12-2025", "UKI12-2025", "ÜKI 12-2025"] and row.b == [] and row.f == ["no_body", "no_anchor"]


def test_texts_are_not_held_as_python_objects_by_the_batch(spark):
    text = "Sayı : 1\n" + "metin " * 10 + "\nSayı : 2\n" + "söz " * 12
    issues = spark.createDataFrame([(i, text) for i in range(150)], "issue int, text string")
    records = spark.createDataFrame([(i, "ae", str(n)) for i in range(150) for n in (1, 2, 3)], "issue int, ref_type string, ref_number string")
    found = G.extract_bodies(records, issues, "issue", "text")
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    assert sorted((r.issue, r.ref_number, r.body is not None) for r in found.collect()) == [(i, n, n != "3") for i in range(150) for n in "123"]
    assert "arrow" in str(G.extract_deadline.evalType).lower() or G.extract_deadline.evalType >= 250

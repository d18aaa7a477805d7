from pyspark.sql import functions as F

from tabulary.functions import text as T


def values(spark, *columns):
    return list(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_case_and_fold(spark):
    lit = F.lit
    assert values(spark, T.turkish_lower(lit("IĞDIR İHALE")), T.turkish_upper(lit("iptal ışık")), T.normalize(lit("  İŞLERİ  Çok "))) == ["ığdır ihale", "İPTAL IŞIK", "isleri cok"]
    assert values(spark, T.title_case_tr(lit("IŞIK İLE İSTİKRAR FONU YASASI")), T.title_case_tr(lit("VE DİĞER HÜKÜMLER"))) == ["Işık ile İstikrar Fonu Yasası", "Ve Diğer Hükümler"]
    assert values(spark, T.title_case(lit("NICOSIA LANGUAGE CENTRE LIMITED")), T.title_case(lit("HASPOLAT GIDA SANAYİ LTD")), T.title_case(lit("Karma yazı"))) == [
        "Nicosia Language Centre Limited", "Haspolat Gıda Sanayi Ltd", "Karma yazı"]


def test_slugs(spark):
    lit = F.lit
    assert values(spark, T.slugify(lit("Kıbrıs'ın İşleri & X")), T.slugify(lit("aa bb cc dd"), 8)) == ["kibrisin-isleri-x", "aa-bb"]
    number = T.record_slug(lit(2025), lit("uki"), lit("12-2025"), lit("Başlık"), lit("7"))
    none = T.record_slug(lit(2025), lit(None).cast("string"), lit(None).cast("string"), lit("Başlık"), lit("7"))
    assert values(spark, number, none) == ["uki-12-2025-baslik", "2025-x-7-baslik"]


def test_suffixes(spark):
    lit = F.lit
    assert values(spark, T.genitive(lit("Toronto Rent A Car Ltd")), T.locative(lit("Haspolat")), T.locative(lit("Alayköy")), T.dative(lit("Fiyat İstikrar Fonu")), T.accusative(lit("Vadili"))) == [
        "Toronto Rent A Car Ltd'in", "Haspolat'ta", "Alayköy'de", "Fiyat İstikrar Fonu'na", "Vadili'yi"]
    assert values(spark, T.ablative_year(lit(2006)), T.ablative_year(lit(1975)), T.dative_year(lit(2006)), T.locative_year(lit(1975)), T.coverage_since(lit(2020))) == [
        "2006'dan", "1975'ten", "2006'ya", "1975'te", "2020'den bugüne"]


def test_labels_and_cuts(spark):
    lit = F.lit
    made = [T.format_issue_numbers(lit(x)) for x in ([200], [146, 145], [126, 124, 125], [150, 145, 146])]
    assert values(spark, *made, T.format_issue_numbers(F.array().cast("array<int>"))) == ["Sayı 200", "Sayı 145 ve 146", "Sayı 124–126", "Sayı 145, 146 ve 150", ""]
    long = "Bir cümle. " * 30
    cut, title, small = values(spark, T.truncate_at_sentence(lit(long)), T.truncate_title(lit("kelime " * 20)), T.truncate_bytes(lit("ğ " * 20_000)))
    assert cut.endswith("cümle.") and len(cut) <= 155 and title.endswith("kelime…") and len(title) <= 61
    assert len(small.encode()) <= 20 * 1024
    assert values(spark, T.lead_in(lit("x" * 300)), T.lead_in(lit("  "))) == ["x" * 200 + "…", None]


def test_quality_and_similarity(spark):
    lit = F.lit
    assert values(spark, T.text_quality(lit("kısa metin")), T.text_quality(lit("güzel bir deneme " * 20)), T.similarity(lit("word"), lit("two words"))) == [None, 1.0, 4 / 11]
    assert values(spark, T.corruption_count(lit("ÜRETiM iLAN ÖDENEKSiZ")), T.needs_reread(lit("ÜRETiM")), T.needs_reread(lit(""))) == [2, True, False]


def test_quality_needs_no_list_of_words(spark):
    df = spark.createDataFrame([("ev evde " * 30 + "qrst brrrk kxa a1b2 ÇOK",), ("az",), (None,)], "t string").select(T.text_quality(F.col("t")).alias("q"))
    assert "split(" not in df._jdf.queryExecution().analyzed().toString()
    assert [r.q for r in df.collect()] == [31 / 34, None, None]

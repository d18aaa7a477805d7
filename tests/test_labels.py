import datetime

import pytest
from pyspark.sql import functions as F

from tabulary.functions import labels as L
from tabulary.operators import logs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_coverage(spark):
    lit, none = F.lit, F.lit(None).cast("int")
    assert one(spark, L.coverage_sentence(lit(2020), lit(2025), lit(12345))) == "2020'den bugüne 12.345 kayıt."
    assert one(spark, L.coverage_sentence(lit(2024), lit(2025), lit(10))) == "Şu an 2024–2025 arasından 10 kayıt; arşiv 2020'ye doğru geriye genişletiliyor."
    assert one(spark, L.coverage_sentence(none, none, lit(0))).startswith("Arşiv henüz") and one(spark, L.coverage_range(lit(2025), lit(2025), lit(1))) == "2025"


def test_letters_and_laws(spark):
    rows = spark.createDataFrame([("Çevre", 1), ("Ceza", 2), ("1 Sayılı", 3), ("âdil", 4), ("işçi", 5), ("ılıman", 6)], "t string, k int")
    assert [(r.letter, r.slug) for r in L.letter_groups(rows, "t", ["k"]).collect()] == [("#", "0-9"), ("A", "a"), ("C", "c"), ("Ç", "ç"), ("I", "ı"), ("İ", "i")]
    keys = spark.createDataFrame([("23/2016",), ("F154",), ("F175A",), ("C12",), ("T:x",), (None,)], "k string")
    assert [r.x for r in keys.select(L.law_reference(F.col("k")).alias("x")).collect()] == ["23/2016", "Fasıl 154", "Fasıl 175A", "Cap. 12", None, None]


def test_circulars(spark):
    lit = F.lit
    assert tuple(one(spark, L.parse_circular(lit(" mia 17/2025 ")))) == ("MİA", "17", 2025, "MİA.17/2025", "mia", "17/2025")
    assert one(spark, L.parse_circular(lit("O.2/2025"))).ref_type == "khko" and one(spark, L.parse_circular(lit("YD.2/2023"))).ref_type is None and one(spark, L.parse_circular(lit("x"))) is None
    assert one(spark, L.circular_date(lit("5 Ağu. 25"))) == "2025-08-05" and one(spark, L.circular_date(lit("31.02.2025"))) == "2025-02-31" and one(spark, L.circular_date(lit("x"))) is None
    assert one(spark, L.circular_title(lit("MT.1/2025"), lit("Su  İşleri"), lit("Yükselme"))).endswith("GENELGE MT.1/2025 SU İŞLERİ YÜKSELME YERİ KADROLARI MÜNHAL İLANI VE SINAVLARI DUYURUSU")
    assert one(spark, L.circular_summary(lit("Su İşleri"), lit("İlk-Atama"))) == "Su İşleri ilk atama kadroları münhal ilanı ve sınavları hakkında duyuru"


def test_titles_and_addresses(spark):
    lit = F.lit
    assert one(spark, L.page_title(lit("Kısa"), lit(12), lit(2025), lit("A.E. 5"))) == "A.E. 5 — Kısa — RG 12/2025"
    assert one(spark, L.page_title(lit("kelime " * 20), lit(0), lit(2025), lit(None).cast("string"))).endswith("… — KHK")
    assert one(spark, L.body_for_description(lit("# Baş\n12\n|---|---|\n**a** | b\nSayı : 5\n"))) == "Baş a b"
    assert one(spark, L.slug_from_address(lit("https://a.example/karar/x-1/"))) == "x-1" and one(spark, L.slug_from_address(lit("https://a.example/konu/x"))) is None


def test_logs_and_versions(spark, tmp_path):
    logs.log_run(spark, f"{tmp_path}/runs", {"run_id": "1", "kind": "daily", "errors": [("2025/1", "late")]})
    logs.log_run(spark, f"{tmp_path}/runs", {"run_id": "2", "kind": "daily"})
    assert {(r.run_id, r.status) for r in spark.read.parquet(f"{tmp_path}/runs").collect()} == {("1", "failed"), ("2", "ok")}
    searches = spark.createDataFrame([("su", 0, datetime.datetime(2025, 1, 1)), (" ", 1, None)], logs.SEARCH)
    logs.log_searches(searches, f"{tmp_path}/searches")
    assert spark.read.parquet(f"{tmp_path}/searches").count() == 1
    with pytest.raises(ValueError):
        logs.latest_version(spark, str(tmp_path))
    spark.range(3).write.parquet(f"{tmp_path}/t/v=0")
    assert logs.replace_table(spark, f"{tmp_path}/t", lambda d: d.where("id > 0")) == 1 and spark.read.parquet(f"{tmp_path}/t/v=1").count() == 2
    rows = spark.createDataFrame([("a",), ("b",)], "user_id string")
    assert (logs.visible_rows(rows, "a", "user_id").count(), logs.visible_rows(rows, None, "user_id").count(), logs.visible_rows(rows, None).count()) == (1, 0, 2)
    assert logs.first_source_with_rows(rows.limit(0), rows).count() == 2

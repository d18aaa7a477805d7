from pyspark.sql import functions as F

from tabulary.functions import summaries as S


def rows(spark, texts, column):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(column(F.col("t")).alias("x")).collect()


def test_mask_keeps_every_letter(spark):
    titles = ["1962 ZORLA MAL İKTİSABI YASASI-GAZİMAĞUSA/VADİLİ", "A.E. 12 SÖZLEŞMELİ PERSONEL / ALİ ÖZCANLI", "KARAR - BİR ŞEY (2025)", "MARKA TESCİL MÜRACAATI İLANI", "", "ÖDENEK AKTARMA/BAŞBAKANLIK 2025 MALİ YILI BÜTÇESİ"]
    got = [[tuple(t) for t in r.x] for r in rows(spark, titles, S.mask_title)]
    assert ["".join(t for t, _ in g) for g in got] == titles
    assert got[0] == [("1962 ZORLA MAL İKTİSABI YASASI-", 0), ("GAZİMAĞUSA/VADİLİ", 1)]
    assert got[1] == [("A.E. 12 SÖZLEŞMELİ PERSONEL / ", 0), ("ALİ ÖZCANLI", 1)]
    assert got[3] == [("MARKA TESCİL MÜRACAATI İLANI", 1)] and got[4] == []
    assert got[5][1:] == [("BAŞBAKANLIK", 1), (" 2025 MALİ YILI BÜTÇESİ", 2)]


def test_summaries(spark):
    titles = [
        "1962 ZORLA MAL İKTİSABI YASASI-GAZİMAĞUSA/VADİLİ", "TESCİLLİ BİR ŞİRKET TASFİYE İŞLEMLERİNE BAŞLANMASI/HASPOLAT GIDA SANAYİ LTD", "ÖDENEK AKTARMA/BAŞBAKANLIK 2025 MALİ YILI BÜTÇESİ",
        "KIBRIS TÜRK ELEKTRİK KURUMU (ELEKTRİK TARİFELERİ)(DEĞİŞİKLİK) TÜZÜĞÜ", "SU KULLANIM BEDELLERİ (DEĞİŞİKLİK) EMİRNAMESİ-LEFKOŞA/ALAYKÖY", "HİÇBİR KURAL",
    ]
    got = [r.x and (r.x.summary, r.x.rule) for r in rows(spark, titles, S.summarize)]
    assert got == [
        ("Gazimağusa Vadili'de kamulaştırma kararı", "kamulastirma"), ("Haspolat Gıda Sanayi Ltd'in tasfiye işlemlerine başlanması", "sirket-tasfiye"),
        ("Başbakanlık 2025 mali yılı bütçesinde ödenek aktarma", "odenek-aktarma"), ("Kıbrıs Türk Elektrik Kurumu Elektrik Tarifeleri tüzüğünde değişiklik", "degisiklik"),
        ("Alayköy'de Su Kullanım Bedelleri emirnamesinde değişiklik", "degisiklik-yerli"), None,
    ]


def test_guard(spark):
    title = "İTİRAZIN REDDEDİLMESİ 318/2025 KARARI"
    cases = [("", "bos"), ("kısa", "cok-kisa"), ("x" * 200, "cok-uzun"), ("Başvuru uygun bulundu diye yazıldı", "sonuc-bildiriyor"), ("Karar 999 sayılı dosyada", "uydurma-sayi"),
             ("Burada özet yok maalesef", "meta-metin"), ("Birinci tümce bitti. İkinci başladı", "cok-cumle"), ("itiraz hakkında 318/2025 sayılı karar.", None)]
    df = spark.createDataFrame([(i, title, c) for i, (c, _) in enumerate(cases)], "i int, t string, c string").orderBy("i")
    got = df.select(S.check_summary(F.col("t"), F.col("c")).alias("x")).collect()
    assert [r.x.reason for r in got] == [w for _, w in cases]
    assert got[-1].x.ok and got[-1].x.summary == "İtiraz hakkında 318/2025 sayılı karar"

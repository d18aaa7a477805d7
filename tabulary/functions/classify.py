"""Classification of gazette records by ordered rule tables.

The tables are fixed values: what the archive's publisher writes in titles. They
are compiled into one chain of conditions, so a record is classified inside the
scan. Rule order is meaning: the first rule that holds decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulary.functions.text import let, turkish_upper

#: Fixed values: (document type, reference types, sections, title keywords); an empty list is no condition.
DOC_TYPE_RULES = (
    ("duzeltme", [], [], ["DÜZELTME:"]),
    ("rekabet_kurulu_karari", ["rekabet"], [], []),
    ("rekabet_kurulu_karari", [], [], ["REKABET KURULU KARAR"]),
    ("eski_eserler_karari", ["eskieser"], [], []),
    ("eski_eserler_karari", [], [], ["ESKİ ESERLER YÜKSEK KURULU"]),
    ("yasa_tasarisi", ["yt"], [], []),
    ("yasa_onerisi", ["yo"], [], []),
    ("genelge", ["mia", "khkmt", "khko"], [], []),
    ("marka_ilani", ["mt"], ["EK_V_B_II"], []),
    ("marka_ilani", [], [], ["MARKA TESCİL MÜRACAATI"]),
    ("sirket_duyurusu", ["sm"], [], []),
    ("sirket_duyurusu", [], [], ["TESCİLLİ BİR YEREL LİMİTED", "İSİM DEĞİŞTİRME MÜRACAATI", "TASFİYE İŞLEMLERİNE BAŞLANMASI", "SİCİLDEN KAYIT SİLİNMESİ", "DENİZAŞIRI YABANCI ŞİRKET TESCİLİ"]),
    ("sirket_duyurusu", [], ["EK_V_B_I"], []),
    ("marka_ilani", [], ["EK_V_B_II"], []),
    ("kamulastirma", [], [], ["ZORLA MAL İKTİSABI", "KAMULAŞTIRMA", "İSTİMLAK"]),
    ("munhal_ilani", [], [], ["MÜNHAL İLANI", "MÜNHAL İLAN", "İLK ATAMA KADROSU"]),
    ("sinav_sonucu", [], [], ["SINAV SONUÇLARI", "SINAV SONUCU", "SINAV NETİCELERİ", "SINAVI NETİCELERİ"]),
    ("anayasa_mahkemesi_karari", [], ["EK_II_B_I"], []),
    ("yasa", [], ["EK_I_B_I"], []),
    ("yasa_gucunde_kararname", [], ["EK_I_B_II"], []),
    ("meclis_karari", [], ["EK_IV_B_II"], []),
    ("gorevden_alma", [], [], ["GÖREVDEN ALINMA", "GÖREVDEN ALMA", "GÖREVİNE SON VERİLMESİ"]),
    ("atama_kararnamesi", [], [], ["SÖZLEŞMELİ PERSONEL", "ATAMA", "GÖREVLENDİRME", "EMEKLİYE SEVK"]),
    ("merkez_bankasi_duyurusu", [], [], ["MERKEZ BANKASI"]),
    ("mahkeme_duyurusu", [], [], ["MAHKEME", "DAVA", "TEBLİGAT"]),
    ("tuzuk", [], [], ["TÜZÜĞÜ", "TÜZÜK"]),
    ("emirname", [], [], ["EMİRNAMESİ", "EMİRNAME", "TEBLİĞİ"]),
    ("bakanlar_kurulu_karari", ["uki", "ukii"], [], []),
    ("bakanlar_kurulu_karari", [], ["EK_IV_B_I"], []),
    ("secim_kurulu_karari", [], [], ["SEÇİM KURULU"]),
    ("sirket_duyurusu", [], [], ["ŞİRKETLER YASASI", "SERBEST LİMAN VE BÖLGE YASASI"]),
)
#: Topics that a document type brings by itself.
TOPIC_BY_DOC_TYPE = {
    "munhal_ilani": "munhal", "sinav_sonucu": "sinav-sonuclari", "rekabet_kurulu_karari": "ihale", "sirket_duyurusu": "sirket",
    "marka_ilani": "marka", "kamulastirma": "gayrimenkul", "yasa": "mevzuat", "yasa_gucunde_kararname": "mevzuat", "tuzuk": "mevzuat",
    "yasa_tasarisi": "mevzuat", "yasa_onerisi": "mevzuat", "emirname": "mevzuat", "atama_kararnamesi": "atama", "gorevden_alma": "atama",
}
#: Fixed values: (topic, title keywords, document types that are left out).
TOPIC_KEYWORDS = (
    ("munhal", ["MÜNHAL", "İLK ATAMA KADROSU", "SON BAŞVURU TARİHİ"], []),
    ("sinav-sonuclari", ["SINAV SONUÇ"], []),
    ("ihale", ["İHALE", "HİZMET ALIMI", "YAPIM İŞİ", "MAL ALIMI", "EKSİLTME"], []),
    ("sirket", ["İSİM DEĞİŞTİRME", "TASFİYE", "SİCİLDEN KAYIT SİLİNMESİ", "DENİZAŞIRI YABANCI ŞİRKET TESCİLİ", "LİMİTED", "İŞLETME İZNİ"], []),
    ("gayrimenkul", ["TAŞINMAZ", "ARAZİ", "PARSEL", "KOÇAN", "PLANLAMA ONAYI", "KIRSAL KESİM ARSASI", "KAMU YOLU", "YOL AYRILMASI", "YOL GENİŞLET", "GEÇİT HAKKI", "MENDİREK", "ZORLA MAL İKTİSABI", "İMAR", "KAMULAŞTIRMA"], []),
    ("marka", ["MARKA"], []),
    ("vergi-mali", ["KATMA DEĞER VERGİSİ", "HARÇ", "FİYAT İSTİKRAR FONU", "AZAMİ SATIŞ FİYATLARI", "PRİM", "FAİZ ORANLARI", "ÖDENEK AKTARMA", "BÜTÇE", "ZORUNLU KARŞILIK", "GÜMRÜK", "MASRAF", "GİDERLER", "KATKI", "MUAFİYET", "KEFALET", "FİNANSMAN"], []),
    ("mevzuat", ["YASASI", "TÜZÜĞÜ", "EMİRNAMESİ", "KARARNAME"], []),
    ("atama", ["SÖZLEŞMELİ PERSONEL", "ATANMASI", "GÖREVLENDİR", "EMEKLİYE SEVK", "GÖREVDEN ALMA", "GÖREVDEN ALINMA"], []),
    ("atama", ["ATANAN KİŞİ", "OLARAK ATAN", "KADROSUNA ATANAN", "TERFİ ETTİRİL", "MEVKİSİNE ATAMA", "MEVKİİNE ATAMA", "MEVKİSİNE ATMALAR"], ["sinav_sonucu"]),
    ("yurttaslik", ["YURTTAŞL"], []),
)
_CIRCULAR = r"(?iu)(?<![A-Za-z0-9_])(M[İIiı]A|MT|YD|Ö|Y)\.?\s*\d+\s*/\s*\d{4}(?![A-Za-z0-9_])"
_BODY_WINDOW, _BODY_LEAST = 1800, 200


def _any(title: Column, keywords) -> Column:
    return reduce(lambda a, b: a | b, (title.contains(k) for k in keywords))


def doc_type(title: Column, section: Column, ref_type: Column) -> Column:
    """The document type of a record; ``diger`` where no rule holds."""


    def first_rule(upper: Column) -> Column:
        chain = None
        for name, refs, sections, keywords in DOC_TYPE_RULES:
            tests = [F.coalesce(ref_type.isin(*refs), F.lit(False))] if refs else []
            tests += [F.coalesce(section.isin(*sections), F.lit(False))] if sections else []
            tests += [_any(upper, keywords)] if keywords else []
            hit = reduce(lambda a, b: a & b, tests)
            chain = F.when(hit, name) if chain is None else chain.when(hit, name)
        return chain.otherwise("diger")

    return let(turkish_upper(title), first_rule)


def topics(title: Column, kind: Column) -> Column:
    """Distinct topics of a record, those of its type first."""
    by_type = F.create_map(*(F.lit(x) for pair in TOPIC_BY_DOC_TYPE.items() for x in pair))[kind]

    def worded(upper: Column) -> Column:
        found = [F.when(_any(upper, words) & ~kind.isin(*out) if out else _any(upper, words), F.lit(topic)) for topic, words, out in TOPIC_KEYWORDS]
        return F.array_distinct(F.filter(F.array(by_type, *found), lambda t: t.isNotNull()))

    return let(turkish_upper(title), worded)


def issuer(title: Column, kind: Column, body: Column) -> Column:
    """``khk`` with evidence for it, ``diger`` with a body that has none, else null."""
    head = F.left(F.coalesce(body, F.lit("")), F.lit(_BODY_WINDOW))
    named = turkish_upper(title).contains("KAMU HİZMETİ KOMİSYON") | turkish_upper(head).contains("KAMU HİZMETİ KOMİSYON")
    khk = named | title.rlike(_CIRCULAR) | head.rlike(_CIRCULAR) | (kind == "genelge")
    return F.when(khk, "khk").when(F.length(F.trim(F.coalesce(body, F.lit("")))) >= _BODY_LEAST, "diger")


def munhal_kind(title: Column, ref_type: Column, by: Column) -> Column:
    """The commission's vacancy category; its reference series decides before the wording."""
    series = F.when(ref_type == "mia", "ilk_atama").when(ref_type == "khkmt", "yukselme").when(ref_type == "khko", "ogretmen")
    worded = lambda t: (
        F.when(_any(t, ["ÖĞRETMEN", "ÖĞRETİM DAİRESİ"]) | t.rlike(r"GENELGE\s+Ö\."), "ogretmen")
        .when(_any(t, ["YÜKSELME", "TERFİ"]), "yukselme").when(_any(t, ["İLK ATAMA", "İLK ATANMA"]), "ilk_atama")
    )
    return F.when(by == "khk", F.coalesce(series, let(turkish_upper(title), worded)))


def personal_data(title: Column, kind: Column) -> Column:
    return (kind == "sinav_sonucu") | _any(turkish_upper(title), ["YASAKLI GÖÇMEN", "SINAV SONUÇLARI"])

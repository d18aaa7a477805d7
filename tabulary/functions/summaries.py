"""Titles split into levels, rule-made summaries, and the guard that checks summaries.

Each table holds an ordered list of patterns; the first one that gives a usable
result decides. Patterns capture every part of what they match, so a title is
never changed by being split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulary.functions import text as T
from tabulary.functions.text import let, squeeze

_REF = r"(?iu)^(?:A\.E\.\s?\d+|Ü\(K-I{1,2}\)\s?[\d-]+|Ş\.M\.\s?\d+|M\.T\.\s?\d+|GENELGE\s+MİA\.[\d/]+|Y\.[TÖ]\.NO:\s?[\d/]+)\s*"
_FORM = "EMİRNAMESİ|TÜZÜĞÜ|TEBLİĞİ"
#: Title patterns with the level of each part (0 boilerplate, 1 distinctive, 2 between).
MASKS = (
    (r"^(\d{4}\s+ZORLA MAL İKTİSABI YASASI)(\s*[-/]\s*)(.+)$", (0, 0, 1)),
    (r"^(.*?İSİM DEĞİŞTİRME MÜRACAATI\s*/\s*)(.+?)(\s+İ[NnȘ]\s+)(.+?)(\s+OLARAK İSMİNİN DEĞİŞMESİ.*)$", (0, 1, 0, 1, 0)),
    (r"^(.*?(?:TASFİYE İŞLEMLERİNE BAŞLANMASI|SİCİLDEN KAYIT SİLİNMESİ)\s*/\s*)(.+)$", (0, 1)),
    (r"^(SÖZLEŞMELİ PERSONEL\s*/\s*)(.+)$", (0, 1)),
    (r"^(ÖDENEK AKTARMA\s*/\s*)(.+?)(\s+\d{4} MALİ YILI BÜTÇESİ)?$", (0, 1, 2)),
    (r"^(KAMU HİZMETİ KOMİSYONU BAŞKANLIĞI,\s*)(.+?)(\s*(?:İLK ATAMA )?KADROSU MÜNHAL İLANI.*|\s*İLK ATAMA KADROSU MÜNHAL İLANI.*)$", (0, 1, 0)),
    (r"^(REKABET KURULU KARARI\s*-\s*KARAR SAYISI:\s*)(\S+)(\s*KONU:\s*)(.+?)(\s+TARAFINDAN\s+)(.+?)(\s+(?:BİNASINA|BİNASI).*)$", (0, 1, 0, 1, 0, 1, 0)),
    (r"^(REKABET KURULU KARARI\s*-\s*KARAR SAYISI:\s*)(\S+)(\s*KONU:\s*)(.+)$", (0, 1, 0, 1)),
    (r"^(MARKA TESCİL MÜRACAATI İLANI\s*/\s*)(.+)$", (0, 1)),
    (r"^(.+?GENELGESİ)(\s*-\s*)(.+)$", (2, 0, 1)),
    (rf"^(.+?)(\s*\(DEĞİŞİKLİK\)\s*(?:{_FORM}))(\s*-\s*)(.+)$", (1, 0, 0, 1)),
    (rf"^(.+?)(\s*\([^)]+\)\s*\(DEĞİŞİKLİK\)\s*(?:{_FORM}|YASASI).*)$", (2, 1)),
    (r"^(\d{4}\s+.+?YASASI)(\s*\(DEĞİŞİKLİK\)\s*YASASI.*)$", (2, 1)),
    (r"^(\d{4}\s+)([^,(]+)(,?\s*\(\s*)([^)]+)(\)\s*\([^)]*\)\s*\(\s*)(DEĞİŞİKLİK)(\s*\).*)$", (2, 1, 0, 1, 0, 1, 0)),
    (r"^(.+?BAKANLIĞI,\s*)(.+?)(\s*MÜNHAL İLANI.*)$", (0, 1, 0)),
)
#: Phrases that say nothing of their own.
BOILERPLATE = (
    "REKABET KURULU KARARI", "KARAR SAYISI", "KARAR NO", "ESKİ ESERLER YÜKSEK KURULU", "MARKA TESCİL MÜRACAATI İLANI", "İSİM DEĞİŞTİRME MÜRACAATI",
    "TASFİYE İŞLEMLERİNE BAŞLANMASI", "SİCİLDEN KAYIT SİLİNMESİ", "TESCİLLİ BİR YEREL LİMİTED ŞİRKETİN", "DENİZAŞIRI YABANCI ŞİRKET TESCİLİ",
    "KADROSU MÜNHAL İLANI VE SINAVI DUYURUSU", "İLK ATAMA KADROSU MÜNHAL İLANI", "KADROSU MÜNHAL İLANI", "MÜNHAL İLANI VE SINAV DUYURUSU", "MÜNHAL İLANI",
    "SINAV SONUÇLARI", "KAMU HİZMETİ KOMİSYONU BAŞKANLIĞI", "ŞİRKETLER MUKAYYİTLİĞİ", "ZORLA MAL İKTİSABI YASASI", "İHALESİNE YAPILAN İTİRAZ",
    "SÖZLEŞMELİ PERSONEL", "ÖDENEK AKTARMA", "KONU:", "DÜZELTME:",
)


def _merged(tokens: Column) -> Column:
    """Neighbours of one level become one token; empty ones go."""
    none = F.array().cast("array<struct<t:string,lvl:int>>")
    begins = lambda ts: F.filter(F.sequence(F.lit(0), F.size(ts) - 1), lambda i: (i == 0) | (F.get(ts, i)["lvl"] != F.get(ts, i - 1)["lvl"]))

    def runs(ts: Column, at: Column) -> Column:
        texts = lambda b, k: F.transform(F.slice(ts, b + 1, F.coalesce(F.get(at, k + 1), F.size(ts)) - b), lambda x: x["t"])
        return F.transform(at, lambda b, k: F.struct(F.array_join(texts(b, k), "").alias("t"), F.get(ts, b)["lvl"].alias("lvl")))

    return let(F.filter(tokens, lambda x: x["t"] != ""), lambda ts: F.when(F.size(ts) > 0, let(begins(ts), lambda at: runs(ts, at))).when(ts.isNotNull(), none))


def mask_title(title: Column) -> Column:
    """array<struct<t, lvl>> of a title: what is boilerplate (0), distinctive (1) and between (2)."""
    token = lambda t, lvl: F.struct(t.alias("t"), lvl.cast("int").alias("lvl"))

    def fallback(t: Column) -> Column:
        parts = F.filter(F.split(t, r"(?<=[/\-–—,:()])(?![/\-–—,:()])|(?<![/\-–—,:()])(?=[/\-–—,:()])"), lambda p: p != "")

        def level(p: Column) -> Column:
            return let(T.turkish_upper(p), lambda upper: level_of(p, upper))

        def level_of(p: Column, upper: Column) -> Column:
            plain = F.exists(F.array(*map(F.lit, BOILERPLATE)), lambda b: upper.contains(b))
            yearly = p.rlike(r"^\s*\d{4}\s*$") | upper.rlike("MALİ YILI|ÖĞRETİM YILI")
            return F.when(p.rlike(r"^[/\-–—,:()\s]+$") | plain, 0).when(yearly, 2).otherwise(1)

        tokens = F.transform(parts, lambda p: token(p, level(p)))
        lifted = lambda ts: F.transform(ts, lambda x: token(x["t"], F.when((x["lvl"] == 0) & ~x["t"].rlike(r"^[/\-–—,:()\s]+$"), 1).otherwise(x["lvl"])))
        return let(tokens, lambda ts: F.when(F.exists(ts, lambda x: x["lvl"] == 1), ts).otherwise(lifted(ts)))

    def split(full: Column) -> Column:
        prefix = F.regexp_extract(full, _REF, 0)
        rest = F.substring(full, F.length(prefix) + 1, F.length(full))

        def body(t: Column) -> Column:
            chain = F.when(t == "", F.array().cast("array<struct<t:string,lvl:int>>"))
            for pattern, levels in MASKS:
                p = "(?iu)" + pattern
                chain = chain.when(t.rlike(p), F.array(*(token(F.regexp_extract(t, p, i + 1), F.lit(v)) for i, v in enumerate(levels))))
            return chain.otherwise(fallback(t))

        return _merged(F.concat(F.array(token(prefix, F.lit(0))), let(rest, body)))

    return let(squeeze(title), split)


def _clean(x: Column) -> Column:
    return F.trim(F.regexp_replace(squeeze(x), r"[.,;:/\-]+$", ""))


def _name(x: Column) -> Column:
    return F.nullif(T.title_case(_clean(x)), F.lit(""))


def _where(x: Column) -> Column:
    parts = F.transform(F.split(_clean(x), "/"), _name)
    first, last = F.get(parts, F.lit(0)), F.element_at(parts, -1)
    return T.locative(F.when(F.size(parts) > 1, F.concat_ws(" ", first, last)).otherwise(last))


def _say(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


#: Fixed values: (name, pattern, sentence from the captured groups), first usable one wins.
SUMMARIES: tuple[tuple[str, str, Callable[..., Column]], ...] = (
    ("kamulastirma", r"^\d{4}\s+ZORLA MAL İKTİSABI YASASI\s*[-/]\s*(.+)$", lambda a: _say(_where(a), " kamulaştırma kararı")),
    ("sirket-isim-degisikligi", r"İSİM DEĞİŞTİRME MÜRACAATI\s*/\s*(.+?)\s+İ[Nn]\s+(.+?)\s+OLARAK İSMİNİN DEĞİŞMESİ", lambda a, b: _say(T.genitive(_name(a)), " isminin ", _name(b), " olarak değişmesi")),
    ("sirket-tasfiye", r"TASFİYE İŞLEMLERİNE BAŞLANMASI\s*/\s*(.+)$", lambda a: _say(T.genitive(_name(a)), " tasfiye işlemlerine başlanması")),
    ("sirket-silme", r"SİCİLDEN KAYIT SİLİNMESİ\s*/\s*(.+)$", lambda a: _say(T.genitive(_name(a)), " sicilden kaydının silinmesi")),
    ("sozlesmeli-personel", r"^SÖZLEŞMELİ PERSONEL\s*/\s*(.+)$", lambda a: _say(T.genitive(_name(a)), " sözleşmeli personel olarak istihdamı")),
    ("odenek-aktarma", r"^ÖDENEK AKTARMA\s*/\s*(.+?)(?:\s+(\d{4})\s+MALİ YILI BÜTÇESİ)?$", lambda a, b: _say(_name(a), F.when(b != "", _say(" ", b, " mali yılı")).otherwise(""), F.when(b != "", " bütçesinde ödenek aktarma").otherwise(" bütçesinde ödenek aktarma"))),
    ("munhal-ilk-atama", r"^KAMU HİZMETİ KOMİSYONU BAŞKANLIĞI,\s*(.+?)\s+İLK ATAMA KADROSU MÜNHAL İLANI", lambda a: _say(_name(a), " ilk atama kadrosu münhal ilanı ve sınav duyurusu")),
    ("munhal-kadro", r"^(?:KAMU HİZMETİ KOMİSYONU BAŞKANLIĞI,\s*)?(.+?)\s+KADROSU MÜNHAL İLANI", lambda a: _say(_name(a), " kadrosu münhal ilanı")),
    ("munhal-genel", r"^(.+?)\s+MÜNHAL İLANI(?:-.+)?$", lambda a: _say(_name(a), " münhal ilanı")),
    ("rekabet-itiraz", r"KONU:\s*(.+?)\s+TARAFINDAN\s+(.+?)\s+İHALESİNE YAPILAN İTİRAZ", lambda a, b: _say(T.genitive(_name(a)), " ", _name(b), " ihalesine yaptığı itiraz hakkında Rekabet Kurulu kararı")),
    ("rekabet-genel", r"^REKABET KURULU KARARI.*?KONU:\s*(.+)$", lambda a: _say(_name(a), " hakkında Rekabet Kurulu kararı")),
    ("marka", r"^MARKA TESCİL MÜRACAATI İLANI\s*/\s*(.+)$", lambda a: _say(T.genitive(_name(a)), " marka tescil müracaatı ilanı")),
    ("genelge", r"^(.+?GENELGESİ)\s*[-/]\s*(.+)$", lambda a, b: _say(_name(b), " hakkında ", F.regexp_replace(_name(a), r"(?iu)\s+Genelgesi$", ""), " genelgesi")),
    ("degisiklik-yerli", rf"^(.+?)\s*\(DEĞİŞİKLİK\)\s*({_FORM})\s*[-/]\s*(.+)$", lambda a, b, c: _say(T.locative(_name(F.element_at(F.split(_clean(c), "/"), -1))), " ", _name(a), " ", F.regexp_replace(T.turkish_lower(_clean(b)), "si$", "sinde"), " değişiklik")),
    ("fon-degisiklik", r"^\d{4}\s+(FİYAT İSTİKRAR FONU)\s*,?\s*\(([^)]+)\)\s*\([^)]*YATIRILACAK[^)]*\)\s*\(DEĞİŞİKLİK\)", lambda a, b: _say(T.dative(_name(a)), " ", T.ablative_from_possessive(F.regexp_replace(T.turkish_lower(_clean(b)), r"\s*,\s*", ", ")), " yatırılacak miktarlarda değişiklik")),
    ("degisiklik", rf"^(.+?)\s*\(([^)]+)\)\s*\(DEĞİŞİKLİK\)\s*({_FORM}|YASASI)", lambda a, b, c: _say(_name(a), " ", _name(b), " ", T.turkish_lower(_clean(c)), "nde değişiklik")),
    ("yasa-degisiklik", r"^(\d{4}\s+.+?YASASI)\s*\(DEĞİŞİKLİK\)\s*YASASI", lambda a: _say(T.genitive(_name(a)), "nda değişiklik")),
)


def summarize(title: Column) -> Column:
    """struct<summary, rule> by the first rule that gives more than eight letters; null without one."""

    def usable(name: str) -> Callable[[Column], Column]:
        return lambda s: F.when(F.length(s) > 8, F.struct(s.alias("summary"), F.lit(name).alias("rule")))

    def made(t: Column) -> Column:
        found = []
        for name, pattern, build in SUMMARIES:
            p = "(?iu)" + pattern
            groups = [F.regexp_extract(t, p, i + 1) for i in range(build.__code__.co_argcount)]
            text = build(*groups)
            whole = let(text, lambda s: F.concat(T.turkish_upper(F.left(s, F.lit(1))), F.substring(s, F.lit(2), F.length(s))))
            found.append(F.when(t.rlike(p), let(whole, usable(name))))
        return F.coalesce(*found)

    return let(F.trim(F.regexp_replace(squeeze(title), _REF, "")), made)


_LETTER = "a-zçğıöşü0-9"
#: Verdicts that a summary may not state unless its title does, and talk about itself.
VERDICTS = (
    "redd?(etti|edildi|edilmiştir|ederek|ine karar|edilmesine|edilmesin[ei])", "kabul (etti|edildi|edilmiştir|edilmesine|ederek)", "onay(ladı|landı|lanmıştır|lanmasına)",
    "ipta?l (etti|edildi|edilmiştir|edilmesine)", "haklı (bulundu|bulunmuştur|görüldü)", "haksız (bulundu|bulunmuştur|görüldü)", "uygun (bulundu|bulunmuştur|görüldü|görülmüştür)",
    "mahk[uû]m (etti|edildi|edilmiştir)", "ceza (verildi|verilmiştir|kesildi)", "para cezasına (çarptırıldı|hükmedildi)", "geçersiz (sayıldı|kılındı|bulundu)",
    "yürürlükten kaldırıldı", "(lehine|aleyhine) (karar|hüküm|hükmedildi)", "suçlu bulundu", "beraat",
)
META = ("özet (üretilemedi|yok|çıkarılamadı|çıkmıyor)", "bilgi (yetersiz|bulunmuyor|yok)", "yeterli bilgi", "belirtilmemiş", "anlaşılamadı")
SHORTEST, LONGEST = 12, 180


def check_summary(title: Column, candidate: Column) -> Column:
    """struct<ok, summary, reason> of a proposed summary: reason names the first test that it fails."""
    word = lambda p: f"(?<![{_LETTER}])(?:{p})(?![{_LETTER}])"
    quotes = "[\"'“”«»]"

    def tested(s: Column) -> Column:
        lower, known = T.turkish_lower(s), T.normalize(title)
        verdict = F.lit(False)
        for p in VERDICTS:
            hit = F.regexp_extract(lower, word(p), 0)
            verdict = verdict | ((hit != "") & ~known.contains(T.normalize(hit)))
        runs = F.regexp_extract_all(s, F.lit(r"(\d+)"), 1)
        invented = F.size(F.array_except(runs, F.regexp_extract_all(title, F.lit(r"(\d+)"), 1))) > 0
        bare = F.regexp_replace(s, "[.!?]+$", "")
        broken = bare.rlike(r"(?<![A-Za-zÇĞİÖŞÜçğıöşü])[a-zçğıöşü]{3,}[.!?]\s+[A-ZÇĞİÖŞÜ]")
        meta = lower.rlike("|".join(map(word, META))) | lower.rlike("başlıktan çıkar|^(üzgünüm|maalesef|bir dil modeli)")
        reason = (
            F.when(s == "", "bos").when(F.length(s) < SHORTEST, "cok-kisa").when(F.length(s) > LONGEST, "cok-uzun").when(meta, "meta-metin").when(verdict, "sonuc-bildiriyor")
            .when(invented, "uydurma-sayi").when(broken, "cok-cumle").when(s == squeeze(title), "baslikla-ayni")
        )
        good = F.trim(bare)
        final = F.when(reason.isNull(), F.concat(T.turkish_upper(F.left(good, F.lit(1))), F.substring(good, F.lit(2), F.length(good)))).otherwise(s)
        return F.struct(reason.isNull().alias("ok"), final.alias("summary"), reason.alias("reason"))

    plain = F.trim(F.regexp_replace(F.regexp_replace(squeeze(F.coalesce(candidate, F.lit(""))), f"^{quotes}", ""), f"{quotes}$", ""))
    return let(plain, tested)

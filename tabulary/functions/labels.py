"""Short labels and addresses: coverage, letters, laws, circulars, page titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulary.functions.text import MONTHS, coverage_since, dative_year, let, squeeze, title_case, truncate_title, turkish_lower, turkish_upper

#: Year the archive is meant to start with, and most letters of a page title.
ARCHIVE_START, TITLE_MOST = 2020, 60
#: Category of a circular, its vacancy kind, title ending and words of its summary.
CATEGORIES = (
    ("[yY]ükselme", "yukselme", "YÜKSELME YERİ KADROLARI MÜNHAL İLANI VE SINAVLARI DUYURUSU", "yükselme yeri kadroları"),
    ("[öÖ]ğretmenlik", "ogretmen", "ÖĞRETMEN MÜNHALİ İLANI VE SINAVLARI DUYURUSU", "öğretmen"),
    ("[iİ]lk-[aA]tama", "ilk_atama", "İLK ATAMA KADROLARI MÜNHAL İLANI VE SINAVLARI DUYURUSU", "ilk atama kadroları"),
)
#: Circular series and their reference types; others are not imported.
SERIES = {"MİA": "mia", "MT": "khkmt", "Ö": "khko", "Y": "genelgey"}
_SHORT_MONTHS = ("oca", "şub", "mar", "nis", "may", "haz", "tem", "ağu", "eyl", "eki", "kas", "ara")


def format_count(n: Column) -> Column:
    """12.345"""
    return F.translate(F.format_number(n, 0), ",", ".")


def coverage_sentence(earliest: Column, latest: Column, total: Column, start: int = ARCHIVE_START) -> Column:
    """What the archive holds: nothing yet, all years, or a range that still grows backwards."""
    count = F.concat(format_count(total), F.lit(" kayıt"))
    span = F.when(earliest == latest, F.concat(F.lit("yalnızca "), earliest.cast("string"), F.lit(" yılından"))).otherwise(F.concat(earliest.cast("string"), F.lit("–"), latest.cast("string"), F.lit(" arasından")))
    growing = F.concat(F.lit("Şu an "), span, F.lit(" "), count, F.lit("; arşiv "), dative_year(F.lit(start)), F.lit(" doğru geriye genişletiliyor."))
    none = earliest.isNull() | (F.coalesce(total, F.lit(0)) == 0)
    return F.when(none, "Arşiv henüz hazırlanıyor, kayıtlar yüklendikçe burada görünecek.").when(earliest <= start, F.concat(coverage_since(F.lit(start)), F.lit(" "), count, F.lit("."))).otherwise(growing)


def coverage_range(earliest: Column, latest: Column, total: Column, start: int = ARCHIVE_START) -> Column:
    none = earliest.isNull() | (F.coalesce(total, F.lit(0)) == 0)
    years = F.when(earliest == latest, earliest.cast("string")).otherwise(F.concat(earliest.cast("string"), F.lit("–"), latest.cast("string")))
    return F.when(~none, F.when(earliest <= start, coverage_since(F.lit(start))).otherwise(years))


def group_letter(title: Column) -> Column:
    """The letter a title is listed under; # for anything but letters."""
    first = F.translate(turkish_upper(F.left(F.trim(title), F.lit(1))), "ÂÎÛ", "AİU")
    return F.when(first.rlike(r"^\p{L}$"), first).otherwise("#")


def letter_slug(letter: Column) -> Column:
    return F.when(letter == "#", "0-9").otherwise(turkish_lower(letter))


def letter_groups(rows: DataFrame, title: str, order: list[str]) -> DataFrame:
    """(letter, slug, titles), # first, then in Turkish order; titles in the order of ``order``, itself last."""
    one = F.struct(*order, F.col(title).alias("__t"))
    made = rows.groupBy(group_letter(F.col(title)).alias("letter")).agg(F.transform(F.sort_array(F.collect_list(one)), lambda s: s["__t"]).alias("titles"))
    return made.select("letter", letter_slug(F.col("letter")).alias("slug"), "titles").orderBy((F.col("letter") != "#"), F.collate("letter", "tr"))


def law_reference(key: Column) -> Column:
    """Fasıl 154, Cap. 12, 23/2016; null for statutes without a number."""
    letter, rest = F.regexp_extract(key, r"^([FC])\d+[A-Z]?$", 1), F.regexp_extract(key, r"^[FC](\d+[A-Z]?)$", 1)
    named = F.when(letter == "F", F.concat(F.lit("Fasıl "), rest)).when(letter == "C", F.concat(F.lit("Cap. "), rest)).otherwise(key)
    return F.when(~(key.startswith("T:") | (key == "")), F.when(key.contains("/"), key).otherwise(named))


def parse_circular(x: Column) -> Column:
    """struct<series, number, year, label, ref_type, ref_number> of a circular's name; null for other texts."""
    pattern = r"(?iu)^(M[İIiı]A|MT|YD|Y|[ÖO])[.\s]*(\d+[A-Z]?)\s*/\s*(\d{4})$"
    part = lambda i: F.upper(F.regexp_extract(F.trim(x), pattern, i))

    def made(raw: Column) -> Column:
        series = F.when(raw.isin("O", "Ö"), "Ö").when(raw.startswith("M") & raw.endswith("A"), "MİA").otherwise(raw)
        number, year = part(2), part(3)
        kind = F.create_map(*(F.lit(v) for pair in SERIES.items() for v in pair))
        ref = F.concat_ws("/", number, year)
        return F.when(raw != "", F.struct(series.alias("series"), number.alias("number"), year.try_cast("int").alias("year"), F.concat(series, F.lit("."), ref).alias("label"), F.try_element_at(kind, series).alias("ref_type"), ref.alias("ref_number")))

    return let(part(1), made)


def circular_date(x: Column) -> Column:
    """yyyy-MM-dd of a listing's date: three letters of a month do, two digits of a year do; days are only
    checked to be from 1 to 31."""
    d, m, y = (F.regexp_extract(x, r"(\d{1,2})[./](\d{1,2})[./](\d{4})", i) for i in (1, 2, 3))
    word = r"(\d{1,2})[.\s]*([A-Za-zÇĞİÖŞÜçğıöşü]+)\.?[\s.]*(\d{2,4})"
    wd, wm, wy = (F.regexp_extract(x, word, i) for i in (1, 2, 3))
    place = F.array_position(F.array(*map(F.lit, _SHORT_MONTHS)), turkish_lower(F.left(wm, F.lit(3))))

    def iso(year: Column, month: Column, day: Column) -> Column:
        good = month.between(1, 12) & day.between(1, 31)
        return F.when(good, F.format_string("%d-%02d-%02d", year, month, day))

    whole = lambda c: c.try_cast("int")
    year = F.when(whole(wy) < 100, whole(wy) + 2000).otherwise(whole(wy))
    return F.when(d != "", iso(whole(y), whole(m), whole(d))).when(wd != "", iso(year, place.cast("int"), whole(wd)))


def _category(category: Column, at: int) -> Column:
    chain = None
    for row in CATEGORIES:
        hit = category.rlike(row[0])
        chain = F.when(hit, row[at]) if chain is None else chain.when(hit, row[at])
    return chain


def circular_kind(category: Column) -> Column:
    return _category(category, 1)


def circular_title(label: Column, department: Column, category: Column) -> Column:
    return F.concat(F.lit("KAMU HİZMETİ KOMİSYONU BAŞKANLIĞI GENELGE "), label, F.lit(" "), turkish_upper(squeeze(department)), F.lit(" "), _category(category, 2))


def circular_summary(department: Column, category: Column) -> Column:
    return F.concat(title_case(turkish_upper(squeeze(department))), F.lit(" "), _category(category, 3), F.lit(" münhal ilanı ve sınavları hakkında duyuru"))


def page_title(title: Column, number: Column, year: Column, reference: Column, most: int = TITLE_MOST) -> Column:
    """Reference, title and issue within ``most`` letters, of which the title gets 24 at least."""
    prefix = F.coalesce(F.concat(reference, F.lit(" — ")), F.lit(""))
    suffix = F.when(number > 0, F.concat(F.lit(" — RG "), number.cast("string"), F.lit("/"), year.cast("string"))).otherwise(" — KHK")
    room = F.greatest(most - F.length(prefix) - F.length(suffix), F.lit(24))
    cut = F.regexp_extract(F.left(squeeze(title), room), "^(.+) ", 1)
    short = F.when(F.length(squeeze(title)) <= room, squeeze(title)).otherwise(F.concat(F.rtrim(F.when(cut != "", cut).otherwise(F.left(squeeze(title), room))), F.lit("…")))
    return F.concat(prefix, short, suffix)


def short_title(title: Column) -> Column:
    return truncate_title(title, TITLE_MOST)


def body_for_description(x: Column) -> Column:
    """A Markdown body as one line: page numbers, rules and number labels left out."""
    lines = F.transform(F.split(x, "\n"), lambda r: F.trim(r))
    good = F.filter(lines, lambda r: (r != "") & ~r.rlike(r"^\(?\d{1,4}\)?$") & ~r.rlike(r"^\|?[\s|:-]*-{3,}[\s|:-]*$") & ~r.rlike(r"(?iu)^Sayı\s*:\s*\d+$"))
    plain = F.transform(good, lambda r: squeeze(F.translate(F.replace(F.regexp_replace(r, r"^#+\s*", ""), F.lit("**"), F.lit("")), "|", " ")))
    return F.array_join(F.filter(plain, lambda r: r != ""), " ")


def slug_from_address(url: Column) -> Column:
    """The record that a page address names; null for other pages and broken addresses."""
    path = F.try_url_decode(F.try_parse_url(url, F.lit("PATH")))
    return F.nullif(F.regexp_extract(path, r"^/karar/([^/]+)/?$", 1), F.lit(""))


def letterhead_date(text: Column) -> Column:
    """yyyy-MM-dd of the first long date in the first 25 lines of a circular."""
    head = F.substring_index(text, "\n", 25)
    return let(F.nullif(F.regexp_extract(head, rf"(\d{{1,2}}\s+(?:{'|'.join(MONTHS)})\s+\d{{4}})", 1), F.lit("")), circular_date)


def canonical_number(typed: Column) -> Column:
    """Digits of a typed Turkish number, its last comma as a point with at most two decimals after it."""
    clean = F.regexp_replace(typed, r"[^\d,]", "")
    whole = F.regexp_replace(F.regexp_replace(clean, ",[^,]*$", ""), ",", "")
    decimals = F.left(F.regexp_extract(clean, ",([^,]*)$", 1), F.lit(2))
    return F.when(clean.contains(","), F.concat(whole, F.lit("."), decimals)).otherwise(clean)


def number_input(canonical: Column) -> Column:
    """A canonical number as shown while it is typed: points between thousands, a comma before decimals."""
    whole = F.regexp_replace(F.substring_index(canonical, ".", 1), r"\B(?=(\d{3})+(?!\d))", ".")
    return F.when(canonical.contains("."), F.concat(whole, F.lit(","), F.regexp_extract(canonical, r"\.(.*)$", 1))).otherwise(whole)

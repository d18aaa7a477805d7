"""Turkish-aware text functions as Column expressions.

Every function takes and gives Columns and stays inside the JVM. Case mapping
goes through ``translate`` first, since plain ``lower('İ')`` gives two code
points and ``lower('I')`` loses the dotless i.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters that fold, and what they fold to.
ACCENTED, PLAIN = "çğıöşüâîû", "cgiosuaiu"
#: Other accented Latin letters that full-text search folds as well.
MORE_ACCENTED, MORE_PLAIN = "àáãäåèéêëìíïñòóõùúýÿ", "aaaaaeeeeiiinooouuyy"
MONTHS = ("Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık")
#: Words that stay small inside a title.
SMALL_WORDS = ("ve", "ile", "veya", "ya", "da", "de", "için", "ait", "ilişkin", "gibi")
#: The apostrophes that slugs leave out.
APOSTROPHES = "'’‘`´"
_SPACE = r"[ \t\n\x0B\f\r   -     　﻿]+"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def turkish_lower(x: Column) -> Column:
    return F.replace(F.lower(F.translate(x, "İI", "iı")), F.lit("̇"), F.lit(""))


def turkish_upper(x: Column) -> Column:
    return F.upper(F.translate(x, "iı", "İI"))


def fold_accents(x: Column) -> Column:
    return F.translate(x, ACCENTED, PLAIN)


def squeeze(x: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(x, _SPACE, " "))


def normalize(x: Column) -> Column:
    """Lower case, folded, single spaces: what titles are compared by."""
    return squeeze(fold_accents(turkish_lower(x)))


def unaccent(x: Column) -> Column:
    """Lower case and folded as full-text search sees it."""
    return F.translate(turkish_lower(x), ACCENTED + MORE_ACCENTED, PLAIN + MORE_PLAIN)


def tidy_whitespace(x: Column) -> Column:
    """Blanks collapse to one; white space around line breaks becomes one break."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[ \t\u00a0]+", " "), r"\s*\n\s*", "\n"))


def slugify(x: Column, longest: int = 80) -> Column:
    """Folded, dashes between words, cut at a dash if that keeps over 60 % of ``longest``."""
    plain = F.regexp_replace(fold_accents(turkish_lower(x)), f"[{APOSTROPHES}]", "")
    base = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")

    def shortened(b: Column) -> Column:
        cut = F.left(b, F.lit(longest))
        head = F.regexp_extract(cut, "^(.*)-[^-]*$", 1)
        at_dash = (F.instr(cut, "-") > 0) & (F.length(head) > longest * 0.6)
        return F.when(F.length(b) <= longest, b).when(at_dash, head).otherwise(cut)

    return let(base, shortened)


def record_slug(year: Column, ref_type: Column, ref_number: Column, title: Column, fallback: Column) -> Column:
    """Year, reference and title; no year where the reference ends in it."""
    has_ref = (F.coalesce(ref_type, F.lit("")) != "") & (F.coalesce(ref_number, F.lit("")) != "")
    ref = F.when(has_ref, F.concat(ref_type, F.lit("-"), slugify(ref_number, 24))).otherwise(F.concat(F.lit("x-"), F.coalesce(fallback.cast("string"), F.lit("0"))))
    same = F.regexp_extract(F.coalesce(ref_number, F.lit("")), r"-(\d{4})$", 1) == year.cast("string")
    title_part = slugify(title, 70)
    return F.concat_ws("-", F.when(~same, year.cast("string")), F.nullif(ref, F.lit("")), F.nullif(title_part, F.lit("")))


def entity_slug(name: Column) -> Column:
    return slugify(name, 70)


def title_case_tr(x: Column) -> Column:
    """A shouted title in the usual case; small words stay small but at the start."""

    def word(w: Column, i: Column) -> Column:
        head = F.regexp_extract(w, r"^([^\p{L}]*)", 1)
        rest = F.substring(w, F.length(head) + 1, F.length(w))
        small = (i > 0) & F.regexp_replace(w, r"[^\p{L}]", "").isin(*SMALL_WORDS)
        cased = F.concat(head, turkish_upper(F.left(rest, F.lit(1))), F.substring(rest, F.lit(2), F.length(w)))
        return F.when(small | (rest == ""), w).otherwise(cased)

    return F.array_join(F.transform(F.split(turkish_lower(squeeze(x)), " "), word), " ")


def truncate_at_sentence(x: Column, longest: int = 155) -> Column:
    """Cut after the last sentence end beyond half of ``longest``, else at a space with an ellipsis."""

    def cut(t: Column) -> Column:
        window = F.left(t, F.lit(longest))
        sentence = F.regexp_extract(window, r"^(.*[.?!]) ", 1)
        head = F.regexp_extract(window, "^(.+) ", 1)
        short = F.when(head != "", head).otherwise(window)
        return F.when(F.length(t) <= longest, t).when(F.length(sentence) - 1 > longest * 0.5, sentence).otherwise(F.concat(F.rtrim(short), F.lit("…")))

    return let(squeeze(x), cut)


def truncate_title(x: Column, longest: int = 60) -> Column:
    def cut(t: Column) -> Column:
        window = F.left(t, F.lit(longest))
        head = F.regexp_extract(window, "^(.+) ", 1)
        return F.when(F.length(t) <= longest, t).otherwise(F.concat(F.rtrim(F.when(head != "", head).otherwise(window)), F.lit("…")))

    return let(squeeze(x), cut)


def truncate_bytes(x: Column, limit: int = 20 * 1024) -> Column:
    """At most ``limit`` UTF-8 bytes, back to the last space; shrinks by tenths as long as it is too long."""
    steps = F.sequence(F.lit(0), F.lit(12))
    shrink = lambda a, _: F.when(F.octet_length(a) > limit, F.left(a, F.floor(F.length(a) * 0.9).cast("int"))).otherwise(a)

    def cut(t: Column) -> Column:
        head = F.regexp_extract(t, "(?s)^(.+) ", 1)
        return F.when(head != "", head).otherwise(t)

    short = F.aggregate(steps, F.left(x, F.lit(limit)), shrink)
    return F.when(F.octet_length(x) <= limit, x).otherwise(let(short, cut))


def format_issue_numbers(numbers: Column) -> Column:
    """``Sayı 200``, ``Sayı 145 ve 146``, ``Sayı 124–126``: the label of a day's issues."""

    def label(s: Column) -> Column:
        n = F.size(s)
        text = F.transform(s, lambda v: v.cast("string"))
        run = (F.element_at(s, -1) - F.get(s, F.lit(0))) == n - 1
        listed = F.concat(F.array_join(F.slice(text, F.lit(1), n - 1), ", "), F.lit(" ve "), F.element_at(text, -1))
        spanned = F.concat(F.get(text, F.lit(0)), F.lit("–"), F.element_at(text, -1))
        many = F.when(run & (n >= 3), spanned).otherwise(listed)
        return F.when(n == 0, F.lit("")).otherwise(F.concat(F.lit("Sayı "), F.when(n == 1, F.get(text, F.lit(0))).otherwise(many)))

    # An empty list has no last element: the branch above needs one to look at.
    return F.when(F.size(numbers) == 0, F.lit("")).otherwise(let(F.array_sort(F.array_distinct(numbers)), label))


def _month(date: Column, letters: int | None) -> Column:
    names = F.array(*(F.lit(m if letters is None else m[:letters]) for m in MONTHS))
    return F.get(names, F.month(date) - 1)


def date_long(date: Column) -> Column:
    """31 Aralık 2025"""
    return F.concat_ws(" ", F.dayofmonth(date).cast("string"), _month(date, None), F.year(date).cast("string"))


def date_short(date: Column) -> Column:
    """31 Ara 2025"""
    return F.concat_ws(" ", F.dayofmonth(date).cast("string"), _month(date, 3), F.year(date).cast("string"))


def deadline_passed(deadline: Column, today: Column) -> Column:
    return F.coalesce(deadline < today, F.lit(False))


def strip_html(x: Column) -> Column:
    """Breaks and block ends become newlines, other tags a space, six entities their character."""
    t = F.regexp_replace(x, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?i)</(p|div|tr|li|td)>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        t = F.regexp_replace(t, f"(?i){entity}", char)
    return t


def lead_in(x: Column, longest: int = 200) -> Column:
    """The first ``longest`` characters; null where blank."""
    t = F.nullif(F.trim(x), F.lit(""))
    return F.when(F.length(t) > longest, F.concat(F.left(t, F.lit(longest)), F.lit("…"))).otherwise(t)


def clean_body(x: Column) -> Column:
    """Without mark-up characters, single spaces."""
    t = F.regexp_replace(x, "[#*`|]", "")
    return squeeze(F.regexp_replace(t, "-{2,}", " "))


def text_quality(x: Column) -> Column:
    """Share of plausible Turkish words among those of three letters or more; null below 20 words."""
    w = "[a-zçğıöşü]"
    plausible = rf"(?<!{w})(?={w}*[aeıioöuü])(?!{w}*[bcçdfgğhjklmnprsştvyz]{{4}})(?!{w}*[qwx]){w}{{3,}}+"
    count = lambda t, pattern: F.regexp_count(t, F.lit(pattern))
    return let(turkish_lower(x), lambda t: let(count(t, f"{w}{{3,}}+"), lambda n: F.when(n >= 20, count(t, plausible) / n)))


def corruption_count(x: Column) -> Column:
    """Lower-case i between capitals, where a capital İ was lost."""
    return F.regexp_count(x, F.lit("[A-ZÇĞÖŞÜ]{2,}i[A-ZÇĞÖŞÜ]"))


def corruption_rate(x: Column) -> Column:
    """Corruptions in ten thousand characters; zero for an empty text."""
    return F.when(F.length(x) > 0, corruption_count(x) * 10000.0 / F.length(x)).otherwise(F.lit(0.0))


def needs_reread(x: Column) -> Column:
    return (corruption_rate(x) >= 2) | (corruption_count(x) >= 15)


def trigrams(x: Column) -> Column:
    """Distinct three-letter windows of each word, padded by two blanks before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(x), "[^\\p{L}\\p{N}]+", " "), " "), lambda w: w != "")

    def of(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, of)))


def similarity(a: Column, b: Column) -> Column:
    """Trigrams in common over trigrams in either; zero where neither has any."""
    shared = lambda x: lambda y: F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))
    return let(trigrams(a), lambda x: let(trigrams(b), shared(x)))


_BACK, _ROUND, _VOWEL = "aıou", "ouöü", "aıoueiöü"
#: Abbreviations without a vowel are read with a front one.
_READ_FRONT = ("ltd", "a.ş.", "as", "kktc", "kdv", "tc")


def _last_word(name: Column) -> Column:
    parts = F.filter(F.split(F.trim(name), r"[\s\-–—]+"), lambda w: w != "")
    return turkish_lower(F.coalesce(F.try_element_at(parts, F.lit(-1)), name))


def _last_vowel(name: Column) -> Column:
    """The vowel that suffixes follow; null where none is known."""
    found = lambda w: F.when(w.rlike(f"[{_VOWEL}]"), F.regexp_extract(w, f"([{_VOWEL}])[^{_VOWEL}]*$", 1)).when(
        F.regexp_replace(w, "[^a-zçğıöşü.]", "").isin(*_READ_FRONT), F.lit("e"))
    return let(_last_word(name), found)


def _last_letter(name: Column) -> Column:
    return F.right(F.regexp_replace(_last_word(name), "[^a-zçğıöşü]", ""), F.lit(1))


def _ends_in(name: Column, letters: str) -> Column:
    return _last_letter(name).rlike(f"^[{letters}]$")


def _back(name: Column) -> Column:
    return F.coalesce(_last_vowel(name).rlike(f"[{_BACK}]"), F.lit(False))


def _narrow(name: Column) -> Column:
    """The narrow vowel in harmony with the name: ı, i, u or ü."""
    v = _last_vowel(name)
    rounded = F.coalesce(v.rlike(f"[{_ROUND}]"), F.lit(False))
    return F.when(_back(name), F.when(rounded, F.lit("u")).otherwise(F.lit("ı"))).otherwise(F.when(rounded, F.lit("ü")).otherwise(F.lit("i")))


def genitive(name: Column) -> Column:
    return F.concat(name, F.lit("'"), F.when(_ends_in(name, _VOWEL), F.lit("n")).otherwise(F.lit("")), _narrow(name), F.lit("n"))


def locative(name: Column) -> Column:
    return F.concat(name, F.lit("'"), F.when(_ends_in(name, "fstkçşhp"), F.lit("t")).otherwise(F.lit("d")), F.when(_back(name), F.lit("a")).otherwise(F.lit("e")))


def dative(name: Column) -> Column:
    return F.concat(name, F.lit("'"), F.when(_ends_in(name, _VOWEL), F.lit("n")).otherwise(F.lit("")), F.when(_back(name), F.lit("a")).otherwise(F.lit("e")))


def accusative(name: Column) -> Column:
    return F.concat(name, F.lit("'"), F.when(_ends_in(name, _VOWEL), F.lit("y")).otherwise(F.lit("")), _narrow(name))


def ablative_from_possessive(name: Column) -> Column:
    return F.concat(name, F.when(_back(name), F.lit("ndan")).otherwise(F.lit("nden")))


#: The last vowel of each digit's and each ten's reading, digits 1 to 9.
_ONES, _TENS = "iiüöeıiiu", "oiuıiıiea"


def _reading(year: Column) -> tuple[Column, Column, Column]:
    """(last spoken vowel, ends in a vowel, ends in a voiceless consonant) of a number."""
    n = F.abs(year)
    ones, tens = n % 10, F.floor(n / 10) % 10
    pick = lambda text, at: F.substring(F.lit(text), at.cast("int"), F.lit(1))
    round_ = F.when((n >= 1000) & (n % 1000 == 0), F.lit("i")).otherwise(F.lit("ü"))
    vowel = F.when(ones > 0, pick(_ONES, ones)).when(tens > 0, pick(_TENS, tens)).otherwise(round_)
    open_ = F.when(ones > 0, ones.isin(2, 6, 7)).otherwise(tens.isin(2, 5))
    voiceless = F.when(ones > 0, ones.isin(3, 4, 5)).otherwise(tens.isin(4, 6, 7))
    return vowel, open_, voiceless


def _year_case(year: Column, back: str, front: str, hard: str = "", soft: str = "", glide: bool = False) -> Column:
    vowel, open_, voiceless = _reading(year)
    lead = F.when(open_, F.lit("y")).otherwise(F.lit("")) if glide else F.when(voiceless, F.lit(hard)).otherwise(F.lit(soft))
    return F.concat(year.cast("string"), F.lit("'"), lead, F.when(vowel.rlike(f"[{_BACK}]"), F.lit(back)).otherwise(F.lit(front)))


def ablative_year(year: Column) -> Column:
    """2006'dan, 1975'ten"""
    return _year_case(year, "an", "en", "t", "d")


def locative_year(year: Column) -> Column:
    """2006'da, 1975'te"""
    return _year_case(year, "a", "e", "t", "d")


def dative_year(year: Column) -> Column:
    """2006'ya, 1975'e"""
    return _year_case(year, "a", "e", glide=True)


def coverage_since(year: Column) -> Column:
    return F.concat(ablative_year(year), F.lit(" bugüne"))


#: Conjunctions that stay small, and company suffixes with their spelling.
_SMALL_IN_NAMES = ("ve", "ile", "veya", "ya", "da", "de", "ki", "ise", "için", "olarak", "bir")
_COMPANY_SUFFIXES = {"ltd": "Ltd", "ltd.": "Ltd.", "limited": "Limited", "limited.": "Limited.", "co": "Co", "co.": "Co.", "inc": "Inc", "inc.": "Inc."}


def title_case(x: Column) -> Column:
    """A name in capitals in the usual case; mixed case is left alone. Abbreviations without
    vowels stay; the phrase decides whether I is a Turkish letter."""

    def cased(t: Column) -> Column:
        turkish = t.rlike("[ÇĞİÖŞÜçğiöşü]")
        suffixes = F.create_map(*(F.lit(v) for pair in _COMPANY_SUFFIXES.items() for v in pair))

        def word(w: Column, i: Column) -> Column:
            small = turkish_lower(w)
            lower = F.when(turkish, small).otherwise(F.lower(w))
            letters = F.regexp_replace(small, "[^a-zçğıöşü]", "")
            acronym = (letters != "") & ~letters.rlike(f"[{_VOWEL}]")
            head = F.left(lower, F.lit(1))
            upper = F.when(turkish, turkish_upper(head)).otherwise(F.upper(head))
            made = F.concat(upper, F.substring(lower, F.lit(2), F.length(w)))
            return F.when((i > 0) & small.isin(*_SMALL_IN_NAMES), lower).when(suffixes[small].isNotNull(), suffixes[small]).when(acronym, w).otherwise(made)

        return F.when(t != turkish_upper(t), t).otherwise(F.array_join(F.transform(F.split(t, " "), word), " "))

    return let(squeeze(x), cased)

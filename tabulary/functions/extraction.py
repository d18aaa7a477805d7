"""Text that comes out of scans and PDF files: glyph codes, tables, readings, law paragraphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulary.functions.text import ACCENTED, corruption_count, let, needs_reread, text_quality, turkish_upper

#: Glyph codes of Turkish letters and quotes, and the shift of the plain ones.
GLYPHS = {
    0x64: "Ç", 0x67: "Ö", 0x68: "Ü", 0xF6: "Ğ", 0xF8: "İ", 0xF9: "Ş", 0x6F: "ç", 0x7C: "ö", 0x81: "ü", 0xF7: "ğ", 0xD5: "ı", 0xFA: "ş", 0xB6: "’", 0xB3: "“", 0xB4: "”",
}
SHIFT, SHIFT_FROM, SHIFT_TO = 29, 0x03, 0x5D
#: A page with fewer letters is a scan; so is a file with fewer letters a byte.
SCAN_LETTERS, SCAN_SHARE, QUALITY_LEAST, KEEP_WORDS = 150, 0.001, 0.55, 0.98
WRAPPED_FROM, HEADING_MOST = 55, 140
_OPENS = r"^(?:Madde(?![A-Za-z0-9_])|\(\d+\)|\([A-Za-zÇĞİÖŞÜçğıöşü]{1,3}\)|\d+\s*\.|[a-zçğıöşü]\)|[IVX]+\.\s)"


def count_glyphs(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"\(cid:\d+\)"))


def decode_glyphs(x: Column) -> Column:
    """``(cid:N)`` as its letter; codes without one vanish."""
    table = F.create_map(*(F.lit(v) for pair in GLYPHS.items() for v in pair))

    def piece(p: Column, i: Column) -> Column:
        digits = F.regexp_extract(p, r"^(\d+)\)", 1)
        code = digits.try_cast("int")
        plain = F.when((code >= SHIFT_FROM) & (code <= SHIFT_TO), F.chr(code + SHIFT)).otherwise(F.lit(""))
        decoded = F.concat(F.coalesce(F.try_element_at(table, code), plain), F.substring(p, F.length(digits) + 2, F.length(p)))
        return F.when(i == 0, p).when(digits == "", F.concat(F.lit("(cid:"), p)).otherwise(decoded)

    return F.array_join(F.transform(F.split(x, r"\(cid:"), piece), "")


def count_words(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"[\p{L}\p{N}]+"))


def looks_scanned(text: Column, pages: Column, size: Column) -> Column:
    """Too few letters a page, or a byte of the file where its pages are unknown."""
    return F.when(F.coalesce(pages, F.lit(0)) > 0, F.length(text) / pages < SCAN_LETTERS).otherwise(F.length(text) / F.greatest(size, F.lit(1)) < SCAN_SHARE)


def keep_rereading(first: Column, again: Column) -> Column:
    """Whether a second reading replaces a damaged first one: fewer damaged words, hardly fewer words."""
    better = (count_words(again) >= count_words(first) * KEEP_WORDS) & (corruption_count(again) < corruption_count(first))
    return needs_reread(first) & F.coalesce(better, F.lit(False))


def extraction_status(text: Column, scanned: Column, read_again: Column) -> Column:
    """failed, needs_review, ocr or extracted; ``scanned`` texts are what OCR gave, null where it failed."""
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    return F.when(blank, "failed").when(F.coalesce(text_quality(text) < QUALITY_LEAST, F.lit(False)), "needs_review").when(scanned | read_again, "ocr").otherwise("extracted")


def repair_table(html: Column) -> Column:
    """struct<text, needs_review>: a table as Markdown; ragged rows are flagged, never guessed."""
    fixed = F.regexp_replace(F.regexp_replace(html, r"<tr>(?!</?td|</?tr)([^<]+)<td>", "<tr><td>$1</td><td>"), r"<tr>\s*<tr>", "<tr>")
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?s)<td[^>]*>(.*?)(?=</td>|<td|</tr>|$)"), 1), lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", "")))
    rows = F.filter(F.transform(F.regexp_extract_all(fixed, F.lit(r"(?s)<tr[^>]*>(.*?)(?=</tr>|<tr|</table>|$)"), 1), cells), lambda r: F.exists(r, lambda c: c != ""))

    def made(rs: Column) -> Column:
        line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
        head = F.get(rs, F.lit(0))
        rule = line(F.transform(head, lambda _: F.lit("---")))
        text = F.array_join(F.concat(F.array(line(head), rule), F.transform(F.slice(rs, F.lit(2), F.size(rs)), line)), "\n")
        ragged = F.exists(rs, lambda r: F.size(r) != F.size(head))
        none = F.size(rs) == 0
        return F.struct(F.when(none, html).otherwise(text).alias("text"), (none | F.coalesce(ragged, F.lit(False))).alias("needs_review"))

    return let(rows, made)


def repair_all_tables(x: Column) -> Column:
    """struct<text, needs_review> of a text with all of its tables repaired."""
    parts = F.split(x, r"(?=<table>)|(?<=</table>)")
    fixed = F.transform(parts, lambda p: F.when(p.startswith("<table>") & p.endswith("</table>"), repair_table(p)).otherwise(F.struct(p.alias("text"), F.lit(False).alias("needs_review"))))
    return let(fixed, lambda f: F.struct(F.array_join(F.transform(f, lambda p: p["text"]), "").alias("text"), F.exists(f, lambda p: p["needs_review"]).alias("needs_review")))


def law_blocks(x: Column) -> Column:
    """array<struct<kind, text>>: headings and paragraphs of a law; wrapped lines are joined.

    A line continues the one above if that one is long and ends no sentence, and
    this one opens nothing new. Lines are joined by one fold over the text.
    """
    lines = F.transform(F.split(x, "\n"), lambda r: F.trim(F.regexp_replace(r, r"[ \t ]+", " ")))
    ends = lambda r: r.rlike("[.;:!?]$")

    def kind(r: Column) -> Column:
        letters = F.length(F.regexp_replace(r, r"[^\p{L}]", ""))
        heading = (letters >= 3) & (F.length(r) <= HEADING_MOST) & (r == turkish_upper(r)) & ~ends(r)
        return F.when(r == "", "blank").when(heading, "heading").otherwise("paragraph")

    typed = F.transform(lines, lambda r: F.struct(kind(r).alias("kind"), r.alias("text")))

    def marked(ts: Column) -> Column:
        def step(t: Column, i: Column) -> Column:
            before = F.get(ts, i - 1)
            joins = (i > 0) & (t["kind"] == "paragraph") & (before["kind"] == "paragraph") & ~t["text"].rlike(_OPENS) & (F.length(before["text"]) >= WRAPPED_FROM) & ~ends(before["text"])
            return F.when(t["kind"] == "blank", F.lit("")).otherwise(F.concat(F.when(joins, F.lit(" ")).otherwise(F.concat(F.lit("\u0001"), F.left(t["kind"], F.lit(1)))), t["text"]))

        return F.array_join(F.transform(ts, step), "")

    blocks = F.filter(F.split(let(typed, marked), "\u0001"), lambda b: b != "")
    return F.transform(blocks, lambda b: F.struct(F.when(b.startswith("h"), "heading").otherwise("paragraph").alias("kind"), F.substring(b, F.lit(2), F.length(b)).alias("text")))


def fold_keeping_length(x: Column) -> Column:
    """Lower case and folded, letter for letter, so that places stay the same."""
    return F.translate(F.lower(F.translate(x, "İI", "iı")), ACCENTED, "cgiosuaiu")

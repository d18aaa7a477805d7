"""Reading a gazette issue: sections, references, records, bodies, entities, deadlines.

Records come from the contents cell of an issue, as an HTML table or as lines of
text. Rows, cells and sections are DataFrame work (rows are exploded, sections
carried down by a window); only the reference finder, the body slicer and the
deadline reader are small Python helpers, for their matches depend on one
another from left to right.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from datetime import date as Date

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulary.functions.text import entity_slug, let, normalize, squeeze, title_case, turkish_upper
from tabulary.operators.lists import carry_down

#: Section headings as printed, and their sections.
SECTIONS = (
    (r"^MA[İI]N$", "MAIN"), (r"^EK\s*I\s*BÖLÜM\s*I$", "EK_I_B_I"), (r"^EK\s*I\s*BÖLÜM\s*II$", "EK_I_B_II"), (r"^EK\s*II\s*BÖLÜM\s*I$", "EK_II_B_I"),
    (r"^EK\s*III$", "EK_III"), (r"^EK\s*IV\s*BÖLÜM\s*I$", "EK_IV_B_I"), (r"^EK\s*IV\s*BÖLÜM\s*II$", "EK_IV_B_II"), (r"^EK\s*V\s*BÖLÜM\s*I$", "EK_V_B_I"),
    (r"^EK\s*V\s*BÖLÜM\s*II$", "EK_V_B_II"), (r"^EK\s*VI$", "EK_VI"),
)
#: Reference types in the order they are tried, their printed form, and whether case matters.
REFERENCES = (
    ("ukii", r"Ü\(K-II\)\s?(\d+-\d{4}|\d+)", True), ("uki", r"Ü\(K-I\)\s?(\d+-\d{4}|\d+)", True), ("skii", r"S\(K-II\)\s?(\d+-\d{4}|\d+)", True),
    ("teki", r"TE\(K-I\)\s?(\d+-\d{4}|\d+)", True), ("fskiii", r"F\.S\.?\(K-III\)\s?(\d+-\d{4}|\d+)", True), ("fski", r"F\.S\.?\(K-I\)\s?(\d+-\d{4}|\d+)", True),
    ("eski", r"E\.S\.?\(K-I\)\s?(\d+-\d{4}|\d+)", True), ("etki", r"E\.T\.?\(K-I\)\s?(\d+-\d{4}|\d+)", True), ("kii", r"K\(II\)[-\s]?(\d+-\d{4}|\d+)", True),
    ("s", r"(?<![A-Za-z0-9_])S-(\d{1,5}-\d{4})", True), ("mia", r"GENELGE\s+MİA\.(\d+/\d{4})", False), ("genelgey", r"GENELGE\s+(?:NO:\s?)?Y\.(\d+/\d{4})", False),
    ("rekabet", r"KARAR\s+SAYISI:\s?(\d+/\d{4})", False), ("eskieser", r"KARAR\s+NO:\s?(\d+/\d+)", False), ("yt", r"Y\.T\.NO:\s?(\d+/\d+/\d{4})", False),
    ("yo", r"Y\.Ö\.NO:\s?(\d+/\d+/\d{4})", False), ("ae", r"A\.E\.\s?(\d+(?:\.\d{3})+|\d+)", True), ("sm", r"Ş\.M\.\s?(\d+)", True), ("mt", r"M\.T\.\s?(\d+)", True),
)
#: References that are the gazette's own numbers.
PRIMARY = ("ae", "uki", "ukii", "s", "skii", "kii", "teki", "eski", "etki", "fski", "fskiii", "sm", "mt", "yt", "yo")
#: What stands before a reference's number on the page.
LABELS = {
    "ae": "A.E. ", "uki": "Ü(K-I) ", "ukii": "Ü(K-II) ", "s": "S-", "skii": "S(K-II) ", "kii": "K(II)-", "teki": "TE(K-I) ", "eski": "E.S(K-I) ",
    "etki": "E.T(K-I) ", "fski": "F.S.(K-I) ", "fskiii": "F.S(K-III) ", "sm": "Ş.M. ", "mt": "M.T. ", "yt": "Y.T.NO:", "yo": "Y.Ö.NO:",
    "mia": "GENELGE MİA.", "khkmt": "GENELGE MT.", "khko": "GENELGE Ö.", "rekabet": "Karar ", "eskieser": "Karar No ", "genelgey": "GENELGE Y.",
}
_SPAN, _SHORT_CELL = 12, 40
_COMPILED = [(t, re.compile(p, 0 if exact else re.I), t in PRIMARY) for t, p, exact in REFERENCES]
_REF = T.ArrayType(T.StructType().add("type", "string").add("number", "string").add("at", "integer").add("main", "boolean"))


def references_in(text: str | None) -> list[tuple[str, str, int, bool]]:
    """(type, number, place, primary) by place; a match near an earlier type's match is part of it."""
    found: list[tuple[str, str, int, bool]] = []
    for kind, pattern, main in _COMPILED:
        for m in pattern.finditer(text or ""):
            if not any(0 <= m.start() - at < _SPAN for _, _, at, _ in found):
                found.append((kind, m[1].replace(".", "") if kind == "ae" else m[1], m.start(), main))
    return sorted(found, key=lambda r: r[2])


@F.pandas_udf(_REF)
def find_references(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [dict(zip(("type", "number", "at", "main"), r, strict=True)) for r in references_in(t)])


def best_references(refs: Column) -> Column:
    """The primary references if there are any, else all."""
    return let(F.filter(refs, lambda r: r["main"]), lambda p: F.when(F.size(p) > 0, p).otherwise(refs))


def section_of(heading: Column) -> Column:
    """The section that a heading names; null for anything else."""
    clean = F.regexp_replace(squeeze(heading), "[:.]+$", "")
    chain = None
    for pattern, name in SECTIONS:
        hit = clean.rlike("(?iu)" + pattern)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain


def format_reference(kind: Column, number: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return F.when((F.coalesce(kind, F.lit("")) != "") & (F.coalesce(number, F.lit("")) != ""), F.concat(F.coalesce(labels[kind], F.lit("")), number))


def reference_aliases(kind: Column, number: Column) -> Column:
    """How people type a reference: its prefix without marks, folded, with and without a blank."""
    label = format_reference(kind, number)
    token = F.element_at(F.split(F.trim(F.left(label, F.length(label) - F.length(number))), r"\s+"), -1)
    code = F.regexp_replace(token, r"[().:\s-]", "")
    fold = F.translate(code, "ÇĞİÖŞÜçğıöşü", "CGIOSUcgiosu")
    made = F.array(F.concat(fold, F.lit(" "), number), F.concat(fold, number), F.when(fold != code, F.concat(code, F.lit(" "), number)))
    usable = token.rlike(r"[().:-]") & token.rlike(r"\p{L}") & (code != "")
    return F.when(usable, F.filter(made, lambda a: a.isNotNull() & (a != label))).otherwise(F.array().cast("array<string>"))


def split_subject(title: Column) -> Column:
    """What follows KONU: in a title; null where nothing does."""
    return F.nullif(F.trim(F.regexp_extract(title, r"(?is)(?<![A-Za-z0-9_])KONU:\s*(.*)$", 1)), F.lit(""))


def _cell_text(html: Column) -> Column:
    t = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return squeeze(t)


def table_rows(issues: DataFrame, keys: list[str], html: str) -> DataFrame:
    """(keys, row, cells): texts of the cells of each innermost table row with any text."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>((?:(?!<tr\b).)*?)</tr>"), 1)
    cells = F.transform(F.regexp_extract_all("__r", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), 1), _cell_text)
    found = issues.select(*keys, F.posexplode(rows).alias("row", "__r")).select(*keys, "row", cells.alias("cells"))
    return found.where(F.exists("cells", lambda c: c != ""))


def parse_contents_table(issues: DataFrame, keys: list[str], html: str) -> DataFrame:
    """(keys, ordinal, section, ref_type, ref_number, title, subject, is_correction) of each record.

    Sections carry down; of the other cells the first short one with a reference is
    the reference (primary ones before others), the longest is the title; without a
    reference cell the title is searched.
    """
    rows = table_rows(issues, keys, html).withColumn("section", section_of(F.get("cells", F.lit(0))))
    rows = carry_down(rows, keys, ["row"], "section").withColumn("section", F.coalesce("section", F.lit("MAIN")))
    rest = rows.withColumn("rest", F.slice("cells", F.lit(2), F.size("cells")))
    cells = rest.select(*keys, "row", F.posexplode("rest").alias("i", "cell")).where((F.col("cell") != "") & (F.length("cell") <= _SHORT_CELL))
    refs = cells.withColumn("refs", find_references("cell")).where(F.size("refs") > 0)
    refs = refs.withColumn("ref", F.get(best_references(F.col("refs")), F.lit(0)))
    first = refs.groupBy(*keys, "row").agg(F.min(F.struct((~F.col("ref.main")).alias("other"), "i", "ref")).alias("best"))
    joined = rest.join(first, [*keys, "row"], "left")
    others = F.transform("rest", lambda c, i: F.struct(F.when(i == F.col("best.i"), F.lit(-1)).otherwise(F.length(c)).alias("n"), (-i).alias("i"), c.alias("c")))
    title = F.when(F.size("rest") > 0, F.array_max(others))
    made = joined.withColumn("__t", title).withColumn("title", F.when(F.col("__t.n") > 0, F.col("__t.c")))
    made = made.withColumn("title", F.coalesce("title", F.get("rest", F.col("best.i")))).where("title is not null")
    made = made.withColumn("__refs", find_references("title")).withColumn("inside", F.get(best_references(F.col("__refs")), F.lit(0)))
    made = made.withColumn("ref", F.coalesce("best.ref", "inside"))
    order = Window.partitionBy(*keys).orderBy("row")
    return made.select(*keys, (F.row_number().over(order) - 1).alias("ordinal"), "section", F.col("ref.type").alias("ref_type"), F.col("ref.number").alias("ref_number"),
                       F.trim("title").alias("title"), split_subject(F.col("title")).alias("subject"), F.col("title").rlike(r"(?iu)^DÜZELTME(?![A-Za-z0-9_])").alias("is_correction"))


def parse_contents_text(issues: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The same columns from lines of text; a line with several references is several records."""
    lines = F.split(F.replace(F.col(text), F.lit("\r"), F.lit("")), "\n")
    rows = issues.select(*keys, F.posexplode(lines).alias("row", "__l")).select(*keys, "row", squeeze(F.col("__l")).alias("line")).where("line <> ''")
    rows = carry_down(rows.withColumn("heading", section_of(F.col("line"))).withColumn("section", F.col("heading")), keys, ["row"], "section")
    rows = rows.where(F.col("heading").isNull() & (F.length("line") >= 6)).withColumn("section", F.coalesce("section", F.lit("MAIN")))
    rows = rows.withColumn("__refs", find_references("line")).withColumn("refs", best_references(F.col("__refs"))).withColumn("is_correction", F.col("line").rlike(r"(?iu)^DÜZELTME\s*:"))
    cut = rows.select("*", F.posexplode_outer("refs").alias("__k", "ref"))
    following = F.get("refs", F.col("__k") + 1)["at"]
    part = F.trim(F.substring("line", F.col("ref.at") + 1, F.coalesce(following, F.length("line")) - F.col("ref.at")))
    marked = F.when(F.col("is_correction") & (F.col("__k") == 0), F.concat(F.lit("DÜZELTME: "), part)).otherwise(part)
    cut = cut.withColumn("title", F.coalesce(F.nullif(marked, F.lit("")), F.col("line")))
    order = Window.partitionBy(*keys).orderBy("row", "__k")
    return cut.select(*keys, (F.row_number().over(order) - 1).alias("ordinal"), "section", F.col("ref.type").alias("ref_type"), F.col("ref.number").alias("ref_number"),
                      "title", split_subject(F.col("title")).alias("subject"), "is_correction")


def body_anchor(kind: Column, number: Column) -> Column:
    """What an issue's text prints where the record's body starts."""
    special = {"ae": "Sayı : ", "eskieser": "KARAR NO: ", "rekabet": "KARAR SAYISI: "}
    chain = F.when(kind.isNull() | number.isNull(), F.lit(None).cast("string"))
    for k, label in special.items():
        chain = chain.when(kind == k, F.concat(F.lit(label), number))
    return chain.otherwise(format_reference(kind, number))


def _elastic(label: str) -> re.Pattern:
    """The label with optional dots and free white space, not followed by a digit."""
    out = []
    for c in label:
        out.append(r"\.?" if c == "." else r"\.?\(" if c == "(" else r"\s*" if c.isspace() else re.escape(c))
    return re.compile("".join(out) + r"(?!\d)", re.I)


def _without_header(text: str) -> str:
    """The next record's header, cut off the end: its number label, and the page number before that."""
    text = text.rstrip()
    while True:
        before = text
        bare = re.sub(r"\s*(?:KARAR\s*SAYISI|Sayı)\s*:?\s*$", "", text, flags=re.I)
        if bare != text:
            text = re.sub(r"(?:\f|\r?\n)[ \t]*\d{1,5}[ \t]*$", "", bare).rstrip()
        text = re.sub(r"\s*\f\s*$", "", text).rstrip()
        if text == before:
            return text


def _folded(text: str) -> tuple[str, list[int]]:
    """The text without white space and dots, letters that match in either case made equal, and where each character stood."""
    kept = [(at, c) for at, c in enumerate(text) if c != "." and not c.isspace()]
    low = (_SAME.get(c) or (c.lower() if len(c.lower()) == 1 else c) for _, c in kept)
    return "".join(low), [at for at, _ in kept]


#: Letters that are equal where case is ignored, beyond their small form.
_SAME = {"İ": "i", "I": "i", "ı": "i", "ſ": "s"}


def label_places(text: str, labels: list[str]) -> dict[str, list[int]]:
    """Where each label begins in the text, with elastic dots and white space.

    One automaton of all labels runs over the folded text once; where it stops, the label's own
    pattern is tried at that place only.
    """
    out: dict[str, list[int]] = {x: [] for x in labels}
    found: dict[str, list[str]] = {}
    for x in out:
        found.setdefault(_folded(x)[0], []).append(x)
    found.pop("", None)
    if not found:
        return out
    automaton = ahocorasick.Automaton()
    for folded, same in found.items():
        automaton.add_word(folded, (len(folded), same))
    automaton.make_automaton()
    folded, place = _folded(text)
    patterns, free = {x: _elastic(x) for x in out}, dict.fromkeys(out, 0)
    for last, (size, same) in automaton.iter(folded):
        at = place[last - size + 1]
        for x in same:
            if at >= free[x] and (m := patterns[x].match(text, at)):
                out[x].append(at)
                free[x] = m.end()
    return out


#: Issues whose bodies a task holds at once.
_AT_ONCE = 64


def slice_bodies(text: str | None, labels: list[str]) -> list[tuple[str, str | None, int | None]]:
    """(label, body, page) of each label: from its first place to the nearest later place of another
    label; bodies of up to 40 characters are null."""
    if not text:
        return [(x, None, None) for x in labels]
    places = label_places(text, labels)
    every = sorted((at, x) for x, found in places.items() for at in found)
    pages = [at for at, c in enumerate(text) if c == "\f"]
    out: list[tuple[str, str | None, int | None]] = []
    for x, found in places.items():
        if not found:
            out.append((x, None, None))
            continue
        k = bisect_left(every, (found[0] + len(x), ""))
        while k < len(every) and every[k][1] == x:
            k += 1
        body = _without_header(text[found[0] : every[k][0] if k < len(every) else len(text)].strip())
        out.append((x, body if len(body) > 40 else None, bisect_left(pages, found[0]) + 1))
    return out


def extract_bodies(records: DataFrame, issues: DataFrame, key: str, text: str) -> DataFrame:
    """``records`` (key, ordinal, ref_type, ref_number, ...) with body and page_from, cut out of their issue's text.

    A text is moved and cut once for its issue; records then meet their bodies by label.
    """
    anchored = records.withColumn("anchor", body_anchor(F.col("ref_type"), F.col("ref_number")))
    labels = anchored.where("anchor is not null").groupBy(key).agg(F.array_sort(F.collect_set("anchor")).alias("labels"))
    schema = T.StructType([issues.select(key).schema[0], T.StructField("anchor", T.StringType()), T.StructField("body", T.StringType()), T.StructField("page_from", T.IntegerType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _AT_ONCE):
                part = batch.slice(lo, _AT_ONCE)
                issue = part.column(0)
                rows = [(i, *r) for i in range(part.num_rows) for r in slice_bodies(part.column(1)[i].as_py(), part.column(2)[i].as_py())]
                at, anchor, body, page = zip(*rows, strict=True) if rows else ((),) * 4
                yield pa.RecordBatch.from_arrays([issue.take(pa.array(at, pa.int32())), pa.array(anchor, pa.string()), pa.array(body, pa.string()), pa.array(page, pa.int32())], names=schema.names)

    bodies = issues.select(key, F.col(text).alias("__text")).join(labels, key).select(key, "__text", "labels").mapInArrow(cut, schema)
    return anchored.join(bodies, [key, "anchor"], "left").select(*records.columns, "anchor", "body", "page_from")


def review_flags(kind: Column, body: Column, anchor: Column) -> Column:
    """no_body (and no_anchor for types without a printed label), neighbor_bleed where the own label occurs again."""
    plain = lambda c: F.regexp_replace(turkish_upper(F.coalesce(c, F.lit(""))), r"\s+", "")
    none = F.coalesce(F.length(F.trim(body)), F.lit(0)) == 0
    twice = let(plain(anchor), lambda a: (a != "") & ((F.length(plain(body)) - F.length(F.replace(plain(body), a, F.lit("")))) > F.length(a)))
    flags = F.array(F.when(none, F.lit("no_body")), F.when(none & anchor.isNull(), F.lit("no_anchor")), F.when(~none & twice, F.lit("neighbor_bleed")))
    return F.filter(flags, lambda f: f.isNotNull())


#: Institutions, and places with their districts.
INSTITUTIONS = (
    "Kamu Hizmeti Komisyonu", "Bakanlar Kurulu", "Cumhuriyet Meclisi", "Anayasa Mahkemesi", "Rekabet Kurulu", "Eski Eserler Yüksek Kurulu",
    "Şirketler Mukayyitliği", "Resmî Kabz Memurluğu", "KKTC Merkez Bankası", "Kıbrıs Türk Elektrik Kurumu", "Maliye Bakanlığı", "Sağlık Bakanlığı",
    "Milli Eğitim Bakanlığı", "İçişleri Bakanlığı", "Dışişleri Bakanlığı", "Turizm ve Çevre Bakanlığı", "Bayındırlık ve Ulaştırma Bakanlığı",
    "Tarım ve Doğal Kaynaklar Bakanlığı", "Çalışma ve Sosyal Güvenlik Bakanlığı", "Ekonomi ve Enerji Bakanlığı", "Başbakanlık", "Gelir ve Vergi Dairesi",
    "Hazine ve Muhasebe Dairesi", "Sosyal Sigortalar Dairesi", "Yataklı Tedavi Kurumları Dairesi", "Gümrük ve Rüsumat Dairesi", "Tapu ve Kadastro Dairesi",
    "Şehir Planlama Dairesi", "Meteoroloji Dairesi",
)
PLACES = (
    ("Lefkoşa", "Lefkoşa"), ("Gönyeli", "Lefkoşa"), ("Alayköy", "Lefkoşa"), ("Haspolat", "Lefkoşa"), ("Hamitköy", "Lefkoşa"), ("Değirmenlik", "Lefkoşa"),
    ("Girne", "Girne"), ("Çatalköy", "Girne"), ("Lapta", "Girne"), ("Alsancak", "Girne"), ("Esentepe", "Girne"), ("Karaoğlanoğlu", "Girne"),
    ("Gazimağusa", "Gazimağusa"), ("Vadili", "Gazimağusa"), ("Geçitkale", "Gazimağusa"), ("Akdoğan", "Gazimağusa"), ("Serdarlı", "Gazimağusa"),
    ("Güzelyurt", "Güzelyurt"), ("Bostancı", "Güzelyurt"), ("Zümrütköy", "Güzelyurt"), ("İskele", "İskele"), ("Bafra", "İskele"), ("Yeniboğaziçi", "İskele"),
    ("Büyükkonuk", "İskele"), ("Dipkarpaz", "İskele"), ("Lefke", "Lefke"), ("Gemikonağı", "Lefke"), ("Yeşilyurt", "Lefke"),
)
_CAPITAL, _NAME = "A-ZÇĞİÖŞÜ", "A-ZÇĞİÖŞÜa-zçğıöşü0-9&.'’\\-"
_COMPANY = rf"(?<![A-Za-z0-9_])([{_CAPITAL}][{_NAME}]*(?:\s+[{_CAPITAL}0-9][{_NAME}]*){{0,6}}\s+(?:LTD|LİMİTED|LIMITED|A\.Ş\.|ANONİM ŞİRKETİ|CO\.|INC\.)\.?)"


def _upper(text: str) -> str:
    return text.translate(str.maketrans("iı", "İI")).upper()


def entities(title: Column, body: Column) -> Column:
    """array<struct<kind, name, slug, normalized, district, confidence>>: 1.0 from the title, 0.7 from the body."""
    text = F.concat(title, F.lit("\n"), F.coalesce(body, F.lit("")))
    flat = lambda c: F.regexp_replace(turkish_upper(c), r"\s+", " ")

    def made(kind: str, name: Column, district: Column, in_title: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), entity_slug(name).alias("slug"), normalize(name).alias("normalized"),
                        district.alias("district"), F.when(in_title, F.lit(1.0)).otherwise(F.lit(0.7)).alias("confidence"))

    def known(upper_title: Column, upper_all: Column) -> Column:
        none = F.lit(None).cast("string")
        out = [F.when(upper_all.contains(_upper(n)), made("institution", title_case(F.lit(n)), none, upper_title.contains(_upper(n)))) for n in INSTITUTIONS]
        for name, district in PLACES:
            pattern = rf"(^|[^{_CAPITAL}]){_upper(name)}(?=$|[^{_CAPITAL}])"
            out.append(F.when(upper_all.contains(_upper(name)) & upper_all.rlike(pattern), made("place", F.lit(name), F.lit(district), upper_title.rlike(pattern))))
        return F.filter(F.array(*out), lambda e: e.isNotNull())

    listed = let(flat(title), lambda t: let(flat(text), lambda a: known(t, a)))
    names = F.filter(F.transform(F.regexp_extract_all(text, F.lit(_COMPANY), 1), squeeze), lambda n: F.length(n) >= 8)
    firms = F.transform(names, lambda n: let(title_case(n), lambda name: made("company", name, F.lit(None).cast("string"), turkish_upper(title).contains(turkish_upper(n)))))
    every = F.concat(listed, firms)
    return let(every, lambda es: F.filter(es, lambda e, i: ~F.exists(F.transform(es, lambda o, j: F.struct(o.alias("o"), j.alias("j"))), lambda p: (p["o"]["slug"] == e["slug"]) & ((p["o"]["confidence"] > e["confidence"]) | ((p["o"]["confidence"] == e["confidence"]) & (p["j"] < i))))))


#: Month names as written, and phrases that a deadline stands near.
_MONTHS = {"ocak": 1, "şubat": 2, "subat": 2, "mart": 3, "nisan": 4, "mayıs": 5, "mayis": 5, "haziran": 6, "temmuz": 7, "ağustos": 8, "agustos": 8,
           "eylül": 9, "eylul": 9, "ekim": 10, "kasım": 11, "kasim": 11, "aralık": 12, "aralik": 12}
_CUES = ("son başvuru", "başvuru süresi", "başvurular", "müracaatlar", "müracaat süresi", "başvuru tarihi", "son müracaat", "teklifler", "ihale tarihi")
_NEAR = 160
_WORD = "[A-Za-zÇĞİÖŞÜçğıöşü]+"
_DAY = rf"(?<!\d)(\d{{1,2}})\s+({_WORD})\s+(\d{{4}})"
_RANGE = re.compile(rf"{_DAY}\s*[-–—]\s*{_DAY}")
_SHORT_RANGE = re.compile(rf"(?<!\d)(\d{{1,2}})\s*[-–—]\s*(\d{{1,2}})\s+({_WORD})\s+(\d{{4}})")
_UNTIL = re.compile(rf"{_DAY}\s+tarihine\s+kadar")
_WRITTEN = re.compile(rf"(\d{{1,2}})\s+({_WORD})\s+(\d{{4}})")
_NUMERIC = re.compile(r"(\d{1,2})[./](\d{1,2})[./](\d{4})")


def _lower(text: str) -> str:
    return text.translate(str.maketrans("İI", "iı")).lower()


def _date(day: str, month: str, year: str) -> Date | None:
    m = int(month) if month.isdigit() else _MONTHS.get(_lower(month))
    try:
        return Date(int(year), m, int(day)) if m else None
    except ValueError:
        return None


def _windows(text: str) -> set[Date]:
    """Ends of application windows; those right after a cue before any others."""
    spans = [(m.start(), _date(*m.group(1, 2, 3)), _date(*m.group(4, 5, 6))) for m in _RANGE.finditer(text)]
    spans += [(m.start(), _date(m[1], m[3], m[4]), _date(m[2], m[3], m[4])) for m in _SHORT_RANGE.finditer(text)]
    spans = [(at, b) for at, a, b in spans if a and b and b >= a]
    cued = {b for at, b in spans if re.search("başvuru|müracaat|randevu", _lower(text[max(0, at - _NEAR) : at]))}
    if spans:
        return cued or {b for _, b in spans}
    ends = [(m.start(), _date(*m.group(1, 2, 3))) for m in _UNTIL.finditer(text)]
    return {d for at, d in ends if d and re.search("başvuru|müracaat", _lower(text[max(0, at - 200) : at]))}


def deadline_in(body: str | None) -> tuple[Date | None, str | None]:
    """The application deadline of a body and a note; ambiguity gives no date, never a guess."""
    if not body:
        return None, None
    text = re.sub(r"\s+", " ", body.replace("**", ""))
    found = _windows(text)
    if not found:
        dates = [(m.start(), _date(*m.group(1, 2, 3))) for p in (_WRITTEN, _NUMERIC) for m in p.finditer(text)]
        dates = [(at, d) for at, d in dates if d]
        if not dates:
            return None, None
        lower = _lower(text)
        found = {d for cue in _CUES for m in re.finditer(cue, lower) for at, d in dates if abs(at - m.start()) <= _NEAR}
    exam = re.search(rf"(?:yazılı\s+)?sınav[^.]{{0,60}}?(\d{{1,2}}\s+{_WORD}\s+\d{{4}})", text, re.I)
    posts = re.search(r"(\b(?:bir|iki|üç|dört|beş|altı|yedi|sekiz|dokuz|on|on iki|on dört|yirmi bir)\b|\d+)\s+kadro", text, re.I)
    note = ", ".join([*(["Yazılı sınav " + exam[1]] if exam else []), *([_lower(posts[0])] if posts else [])])
    return (next(iter(found)) if len(found) == 1 else None), note or None


@F.arrow_udf(T.StructType().add("deadline_at", "date").add("note", "string"))
def extract_deadline(body: pa.Array) -> pa.Array:
    """One text at a time: a batch's texts are not all Python objects at once."""
    rows = [deadline_in(b.as_py()) for b in body]
    return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.date32()), pa.array([r[1] for r in rows], pa.string())], names=["deadline_at", "note"])

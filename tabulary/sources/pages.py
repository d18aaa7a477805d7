"""Landing pages as sources: archive listings, circular listings, exchange rates.

Pages are fetched outside Spark and read as whole texts; here they become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulary.functions.gazette import table_rows
from tabulary.functions.text import MONTHS, turkish_lower

#: Month names by number, with their plain spellings.
_MONTH_NUMBER = {n.translate(str.maketrans("İIŞĞÜÖÇşğüöçı", "iışğüöçşğüöçı")).lower(): i + 1 for i, n in enumerate(MONTHS)}


def turkish_date(x: Column) -> Column:
    """The first date of a text, written with a month name or with ``. , /``; null unless the day exists."""
    t = turkish_lower(x)
    d, m, y = (F.regexp_extract(t, r"(\d{1,2})\s*[.,/]+\s*(\d{1,2})\s*[.,/]+\s*(\d{4})", i) for i in (1, 2, 3))
    wd, wm, wy = (F.regexp_extract(t, r"(\d{1,2})\s+([a-zçğıöşü]+)\s+(\d{4})", i) for i in (1, 2, 3))
    names = F.create_map(*(F.lit(v) for pair in _MONTH_NUMBER.items() for v in pair))
    made = lambda day, month, year: F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    return F.coalesce(F.when(d != "", made(d, m, y)), F.when(wd != "", made(wd, F.try_element_at(names, wm).cast("string"), wy)))


def issue_number(x: Column) -> Column:
    """The first whole number of a text, from 1 to 999."""
    n = F.nullif(F.regexp_extract(x, r"(\d+)", 1), F.lit("")).try_cast("int")
    return F.when((n >= 1) & (n <= 999), n)


def absolute_url(href: Column, host: str, archive: str) -> Column:
    """Full address of a link: portal files stand on ``host``, the rest below ``archive``."""
    return F.when(href.rlike("^https?://"), href).when(href.startswith("/Portals/"), F.concat(F.lit(host), href)).otherwise(F.concat(F.lit(archive.rstrip("/") + "/"), F.ltrim(href, F.lit("/"))))


def archive_issues(pages: DataFrame, html: str, year: str) -> DataFrame:
    """(year, number, published_at, pdf_href): rows of three cells or more that have number, date and link."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>((?:(?!<tr\b).)*?)</tr>"), 1)
    found = pages.select(year, F.explode(rows).alias("r"))
    cells = F.regexp_extract_all("r", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), 1)
    plain = F.transform(cells, lambda c: F.trim(F.regexp_replace(c, "(?s)<[^>]*>", " ")))
    found = found.select(year, plain.alias("cells"), F.regexp_extract("r", r"""(?i)href\s*=\s*["']([^"']+)["']""", 1).alias("pdf_href"))
    found = found.where(F.size("cells") >= 3).select(year, issue_number(F.get("cells", F.lit(0))).alias("number"), turkish_date(F.get("cells", F.lit(1))).alias("published_at"), "pdf_href")
    return found.where("number is not null and published_at is not null and pdf_href <> ''")


def circular_listing(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """(keys, row, cells, pdf_href) of a listing's rows that link to a PDF."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>((?:(?!<tr\b).)*?)</tr>"), 1)
    link = F.regexp_extract("__r", r"""(?i)href\s*=\s*["']([^"']+\.pdf)["']""", 1)
    links = pages.select(*keys, F.posexplode(rows).alias("row", "__r")).select(*keys, "row", link.alias("pdf_href")).where("pdf_href <> ''")
    return table_rows(pages, keys, html).join(links, [*keys, "row"])


#: The currencies of the bank's rates.
CURRENCIES = ("GBP", "EUR", "USD", "JPY")


def exchange_rates(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """(keys, date, currency, rate, banknote): selling rates per unit, six decimals, of a rates page's first table.

    Rows begin with a unit, a name and the currency in brackets; pages without date or table give none.
    """
    date = F.regexp_extract(html, r"(\d{2}/\d{2}/\d{4})\s*-\s*Tarihinde Geçerli Olan Resmi Kurlar", 1)
    table = F.regexp_extract(html, r"(?s)edit-resmi-kur-table(.*?)(?:</table>|$)", 1)
    found = pages.select(*keys, date.alias("date"), F.explode(F.slice(F.split(table, r"<tr[\s>]"), 2, 1 << 20)).alias("r")).where("date <> ''")
    cells = F.transform(F.regexp_extract_all("r", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), 1), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " ")))
    rows = found.select(*keys, "date", cells.alias("c"))
    unit, currency = (F.regexp_extract(F.get("c", F.lit(0)), r"^(\d+)\s.*\((\w{3})\)$", i) for i in (1, 2))
    per_unit = lambda i: F.when(F.get("c", F.lit(i)).try_cast("double") > 0, F.round(F.get("c", F.lit(i)).try_cast("double") / unit.try_cast("double"), 6))
    made = rows.select(*keys, "date", currency.alias("currency"), per_unit(2).alias("rate"), per_unit(4).alias("banknote"))
    return made.where(F.col("currency").isin(*CURRENCIES))


def archive_address(base: str, year: Column) -> Column:
    """The archive's page of a year."""
    return F.concat(F.lit(base.rstrip("/") + "/AR%C5%9E%C4%B0V/"), year.cast("string"))


def linked_files(pages: DataFrame, keys: list[str], html: str, prefix: str = "", ending: str = ".pdf") -> DataFrame:
    """(keys, link): distinct links of pages that begin with ``prefix`` and end in ``ending``, in either case."""
    links = F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*["']([^"']+)["']"""), 1)
    return pages.select(*keys, F.explode(links).alias("link")).where(F.col("link").startswith(prefix) & F.lower("link").endswith(ending)).distinct()


def text_fixtures(spark, folder: str) -> DataFrame:
    """(year, number, text) of files <year>-<number>.txt, read whole."""
    files = spark.read.text(f"{folder}/*.txt", wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("text"))
    part = lambda i: F.regexp_extract("file", r"^(\d+)-(\d+)\.txt$", i).try_cast("int")
    return files.select(part(1).alias("year"), part(2).alias("number"), "text").where("year is not null")


def circular_fixtures(spark, folder: str) -> DataFrame:
    """(label, text, and the fields of the JSON beside it) of files <label>.md and <label>.json."""
    name = lambda end: F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)\.{end}$", 1)
    texts = spark.read.text(f"{folder}/*.md", wholetext=True).select(name("md").alias("label"), F.col("value").alias("text"))
    facts = spark.read.json(f"{folder}/*.json", multiLine=True)
    return texts.join(facts.withColumn("label", name("json")), "label", "left")

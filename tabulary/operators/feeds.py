"""Feeds and sitemaps as DataFrames of ready lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulary.operators.lists import numbered, recent

#: Entries of a feed, and addresses of a sitemap file.
FEED_SIZE, CHUNK_SIZE = 50, 45_000


def xml_escape(x: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(char), F.lit(entity))
    return x


def rss_items(records: DataFrame, base: str, size: int = FEED_SIZE) -> DataFrame:
    """(position, item): the newest records with slug, title, summary and published_at."""
    newest = records.orderBy(F.desc("published_at"), F.desc("id")).limit(size)
    link = xml_escape(F.concat(F.lit(base), F.col("slug")))
    parts = [F.lit("<item><title>"), xml_escape(F.col("title")), F.lit("</title><link>"), link, F.lit("</link><description>"), xml_escape(F.coalesce("summary", "title")),
             F.lit("</description><pubDate>"), F.date_format("published_at", "EEE, dd MMM yyyy"), F.lit(" 00:00:00 GMT</pubDate></item>")]
    return newest.select(F.struct("published_at", "id").alias("position"), F.concat(*parts).alias("item"))


def sitemap(rows: DataFrame, address: Column, changed: Column, priority: Column, order: list[Column], size: int = CHUNK_SIZE) -> DataFrame:
    """(chunk, loc, lastmod, priority): addresses in ``order``, ``size`` to a file."""
    made = numbered(rows, order, "__place")
    return made.select(F.floor(F.col("__place") / size).cast("int").alias("chunk"), address.alias("loc"), changed.alias("lastmod"), priority.alias("priority"))


def recent_chunk(records: DataFrame, today: Column, months: int = 6) -> DataFrame:
    """Records of the last months with a page of their own; the archive has all others."""
    return records.where(F.col("has_own_page") & recent(F.col("published_at"), today, months))

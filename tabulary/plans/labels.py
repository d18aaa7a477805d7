"""Queries of ranks, short labels and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulary.functions import labels as L
from tabulary.operators import search as S
from tabulary.plans.archive import _DOCS, _docs
from tabulary.sources.tables import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


@query(rf"""WITH {_DOCS}, words AS (SELECT doc_id, unnest(string_split(trim(t), ' ')) AS w, generate_subscripts(string_split(trim(t), ' '), 1) AS pos FROM docs),
hits AS (SELECT doc_id, pos, w LIKE 'the%' AS a, w LIKE 'is%' AS b, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM words WHERE w LIKE 'the%' OR w LIKE 'is%'),
ends AS (SELECT doc_id, pos, k, greatest(min(pos) FILTER (WHERE a) OVER w, min(pos) FILTER (WHERE b) OVER w) AS q,
  (min(pos) FILTER (WHERE a) OVER w) IS NOT NULL AND (min(pos) FILTER (WHERE b) OVER w) IS NOT NULL AS whole
  FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
covers AS (SELECT doc_id, q, max(pos) AS p, max(k) AS kp FROM ends WHERE whole GROUP BY doc_id, q)
SELECT c.doc_id, round(sum(0.1::DOUBLE / (1 + c.q - c.p - (h.k - c.kp))), 6) AS density FROM covers c JOIN hits h ON h.doc_id = c.doc_id AND h.pos = c.q GROUP BY c.doc_id""")
def search_rank(spark, d):
    docs = _docs(spark, d)
    return docs.where(S.loose(F.col("t"), "the is")).select("doc_id", F.round(S.cover_density(F.col("t"), "the is"), 6).alias("density"))


@query(f"WITH ranked AS ({SQL['search_rank']}) SELECT r.doc_id, round(density * CASE WHEN doc_id % 900 < 90 THEN 1.5 WHEN doc_id % 900 < 365 THEN 1.2 ELSE 1.0 END::DOUBLE, 6) AS rank FROM ranked r")
def search_rank_boosted(spark, d):
    day = F.date_sub(F.lit("2000-06-01").cast("date"), (F.col("doc_id") % 900).cast("int"))
    docs = _docs(spark, d).where(S.loose(F.col("t"), "the is"))
    return docs.select("doc_id", F.round(S.rank(F.col("t"), "the is", day, F.lit("2000-06-01").cast("date")), 6).alias("rank"))


@query(rf"""WITH {_DOCS}, words AS (SELECT doc_id, unnest(string_split(trim(t), ' ')) AS w, generate_subscripts(string_split(trim(t), ' '), 1) AS pos FROM docs),
hits AS (SELECT doc_id, pos, w LIKE 'the%' AS a, w LIKE 'is%' AS b, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, sum(CASE WHEN pos <= 8 THEN 1.0 ELSE 5.0 END::DOUBLE) OVER (PARTITION BY doc_id ORDER BY pos) AS upto, CASE WHEN pos <= 8 THEN 1.0 ELSE 5.0 END::DOUBLE AS inv FROM words WHERE w LIKE 'the%' OR w LIKE 'is%'),
ends AS (SELECT doc_id, pos, k, greatest(min(pos) FILTER (WHERE a) OVER w, min(pos) FILTER (WHERE b) OVER w) AS q,
  (min(pos) FILTER (WHERE a) OVER w) IS NOT NULL AND (min(pos) FILTER (WHERE b) OVER w) IS NOT NULL AS whole
  FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
covers AS (SELECT doc_id, q, max(pos) AS p FROM ends WHERE whole GROUP BY doc_id, q)
SELECT c.doc_id, round(sum((h.k - g.k + 1) / (h.upto - g.upto + g.inv) / (1 + c.q - c.p - (h.k - g.k))), 6) AS density
FROM covers c JOIN hits h ON h.doc_id = c.doc_id AND h.pos = c.q JOIN hits g ON g.doc_id = c.doc_id AND g.pos = c.p GROUP BY c.doc_id""")
def search_rank_weighted(spark, d):
    """The first eight words of a text are its title, the rest its body."""
    docs = _docs(spark, d).where(S.loose(F.col("t"), "the is"))
    words = F.split(F.trim("t"), " ")
    texts = [(F.array_join(F.slice(words, 1, 8), " "), S.CLASS_WEIGHTS["A"]), (F.array_join(F.slice(words, 9, 1 << 30), " "), S.CLASS_WEIGHTS["C"])]
    return docs.select("doc_id", F.round(S.weighted_density(texts, "the is"), 6).alias("density"))


@query("""SELECT o_orderpriority AS topic, CASE WHEN min(year(o_orderdate)) = max(year(o_orderdate)) THEN min(year(o_orderdate))::VARCHAR ELSE min(year(o_orderdate)) || '–' || max(year(o_orderdate)) END AS years,
replace(format('{:,}', count(*)), ',', '.') AS records FROM orders GROUP BY o_orderpriority""")
def coverage_labels(spark, d):
    year = F.year("o_orderdate")
    sums = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("topic")).agg(F.min(year).alias("a"), F.max(year).alias("b"), F.count("*").alias("n"))
    return sums.select("topic", L.coverage_range(F.col("a"), F.col("b"), F.col("n"), 1900).alias("years"), L.format_count(F.col("n")).alias("records"))


_KEYS = ("MİA", "MT", "O", "Y", "YD")


@query("""WITH r AS (SELECT o_orderkey, o_orderdate, ['MİA', 'MT', 'Ö', 'Y', 'YD'][o_orderkey % 5 + 1] AS series, (o_orderkey % 40 + 1)::VARCHAR AS number, year(o_orderdate)::INT AS year FROM orders)
SELECT o_orderkey, series, number, year, series || '.' || number || '/' || year AS label,
CASE series WHEN 'MİA' THEN 'mia' WHEN 'MT' THEN 'khkmt' WHEN 'Ö' THEN 'khko' WHEN 'Y' THEN 'genelgey' END AS ref_type, strftime(o_orderdate, '%Y-%m-%d') AS listed_on FROM r""")
def circular_labels(spark, d):
    o = read(spark, d, "orders")
    name = F.concat(F.get(F.array(*map(F.lit, _KEYS)), (F.col("o_orderkey") % 5).cast("int")), F.lit(". "), F.col("o_orderkey") % 40 + 1, F.lit(" / "), F.year("o_orderdate"))
    made = o.select("o_orderkey", L.parse_circular(name).alias("c"), L.circular_date(F.date_format("o_orderdate", "d.M.yyyy")).alias("listed_on"))
    return made.select("o_orderkey", "c.series", "c.number", "c.year", "c.label", "c.ref_type", "listed_on")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Fasıl ' || p_size WHEN 1 THEN 'Cap. ' || p_size || 'A' WHEN 2 THEN p_size || '/2016' END AS reference FROM part""")
def law_references(spark, d):
    kind, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    key = F.when(kind == 0, F.concat(F.lit("F"), size)).when(kind == 1, F.concat(F.lit("C"), size, F.lit("A"))).when(kind == 2, F.concat(size, F.lit("/2016"))).otherwise("T:x")
    return read(spark, d, "part").select("p_partkey", L.law_reference(key).alias("reference"))


@query("""SELECT 'clerk-' || (o_custkey % 97) AS slug, sum(o_orderkey % 3)::BIGINT AS clicks FROM orders WHERE o_orderkey % 2 = 0 GROUP BY slug HAVING sum(o_orderkey % 3) > 0""")
def clicks_per_page(spark, d):
    path = F.when(F.col("o_orderkey") % 2 == 0, "karar").otherwise("konu")
    url = F.concat(F.lit("https://archive.example/"), path, F.lit("/clerk-"), F.col("o_custkey") % 97, F.lit("/"))
    found = read(spark, d, "orders").select(L.slug_from_address(url).alias("slug"), (F.col("o_orderkey") % 3).alias("n")).where("slug is not null")
    return found.groupBy("slug").agg(F.sum("n").alias("clicks")).where("clicks > 0")

"""Queries of links between records, feeds, title tools and the larger calculators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulary.functions import extraction as X
from tabulary.functions import summaries as Y
from tabulary.functions import title_deed as D
from tabulary.functions import vehicle_import as V
from tabulary.operators import feeds, linking
from tabulary.operators import index as I
from tabulary.operators import search as S
from tabulary.plans.archive import _DOCS, _FOLD, _postings
from tabulary.sources.tables import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _records(spark, d):
    """Orders as records: customers as issues, states as reference types, priorities as titles."""
    o = read(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "O", "ae").when(F.col("o_orderstatus") == "F", "uki").otherwise("yt")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("issue_id"), kind.alias("ref_type"), (F.col("o_custkey") % 50).cast("string").alias("ref_number"),
        F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("DÜZELTME "), "o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("title"), F.col("o_orderdate").cast("date").alias("published_at"),
        F.lit(None).cast("long").alias("related_record_id"), F.lit(None).cast("long").alias("corrects_id"), F.year("o_orderdate").alias("year"), (F.col("o_orderkey") % 300).cast("int").alias("number"),
    )


_RECORDS = """WITH r AS (SELECT o_orderkey AS id, o_custkey AS issue_id, CASE o_orderstatus WHEN 'O' THEN 'ae' WHEN 'F' THEN 'uki' ELSE 'yt' END AS ref_type, (o_custkey % 50)::VARCHAR AS ref_number,
CASE WHEN o_orderkey % 7 = 0 THEN 'DÜZELTME ' ELSE '' END || o_orderpriority AS title, o_orderdate::DATE AS published_at, year(o_orderdate)::INT AS year, (o_orderkey % 300)::INT AS number FROM orders)"""


@query(f"{_RECORDS} SELECT a.id, min(b.id) AS related_id FROM r a JOIN r b ON a.ref_type = 'ae' AND b.ref_type IN ('uki', 'ukii') AND a.issue_id = b.issue_id AND a.title = b.title GROUP BY a.id")
def related_records(spark, d):
    return linking.related_records(_records(spark, d))


@query(f"""{_RECORDS} SELECT f.id, arg_max(s.id, (s.published_at, s.id)) AS corrects_id FROM r f JOIN r s ON f.title LIKE 'DÜZELTME%' AND s.ref_type = f.ref_type AND s.ref_number = f.ref_number AND s.published_at < f.published_at GROUP BY f.id""")
def corrected_records(spark, d):
    return linking.corrected_records(_records(spark, d))


@query(f"{_RECORDS} SELECT id FROM r WHERE NOT (year = 1997 AND number = 12 AND ref_type = 'ae' AND ref_number = '3') AND NOT (year = 1998 AND number = 5 AND ref_type = 'uki' AND ref_number = '4')")
def takedowns(spark, d):
    removed = spark.createDataFrame([(1997, 12, "ae", "3"), (1998, 5, "uki", "4")], "year int, number int, ref_type string, ref_number string")
    return linking.without_takedowns(_records(spark, d), removed).select("id")


@query(f"{_RECORDS} SELECT id, CASE WHEN issue_id % 2 = 0 THEN DATE '2000-01-01' ELSE published_at END AS published_at FROM r")
def propagated_dates(spark, d):
    issues = read(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit("2000-01-01").cast("date").alias("published_at"))
    return linking.with_issue_dates(_records(spark, d), issues).select("id", "published_at")


@query("""WITH s AS (SELECT doc_id AS id, lang AS title, source AS doc_type, CASE WHEN doc_id % 3 = 0 THEN 'sum' || doc_id END AS summary FROM documents), k AS (SELECT title, doc_type, arg_min(summary, id) AS summary FROM s WHERE summary IS NOT NULL GROUP BY 1, 2)
SELECT s.id, k.summary FROM s JOIN k ON s.title IS NOT DISTINCT FROM k.title AND s.doc_type IS NOT DISTINCT FROM k.doc_type WHERE s.summary IS NULL""")
def reused_summaries(spark, d):
    docs = read(spark, d, "documents")
    none = F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.col("source").alias("doc_type"), none.alias("section"), none.alias("ref_type"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("sum"), "doc_id")).alias("summary"))
    return linking.reuse_summaries(rows)


@query("""SELECT '<item><title>' || o_orderpriority || '</title><link>https://archive.example/' || o_orderkey || '</link><description>' || o_orderpriority || '</description><pubDate>' || strftime(o_orderdate, '%a, %d %b %Y') || ' 00:00:00 GMT</pubDate></item>' AS item
FROM orders ORDER BY o_orderdate::DATE DESC, o_orderkey DESC LIMIT 50""")
def rss_feed(spark, d):
    rows = _records(spark, d).withColumns({"slug": F.col("id").cast("string"), "summary": F.lit(None).cast("string"), "title": F.regexp_replace("title", "^DÜZELTME ", "")})
    return feeds.rss_items(rows, "https://archive.example/").select("item")


@query("""SELECT ((row_number() OVER (ORDER BY o_orderdate::DATE DESC, o_orderkey DESC) - 1) // 1000)::INT AS chunk, 'https://archive.example/' || o_orderkey AS loc, o_orderdate::DATE AS lastmod, 0.5::DOUBLE AS priority FROM orders""")
def sitemap_chunks(spark, d):
    """Addresses of all orders, the latest first, in files of 1,000."""
    r = _records(spark, d)
    return feeds.sitemap(r, F.concat(F.lit("https://archive.example/"), "id"), F.col("published_at").cast("date"), F.lit(0.5), [F.desc(F.col("published_at").cast("date")), F.desc("id")], 1000)


@query("""WITH a AS (SELECT c_custkey, greatest(floor(c_acctbal) * 1000, 0) AS a FROM customer)
SELECT c_custkey, round(round(a * 0.06, 2) + round(a * 0.0005, 2) + 220 + round(a * 0.005, 2) + round(a * 0.05, 2), 1) AS total, round(round(a * 0.028, 2), 1) AS seller_total FROM a""")
def title_deed_fee(spark, d):
    given = {"transaction": F.lit("sale"), "buyer": F.lit("kktc"), "amount": F.floor("c_acctbal") * 1000, "fixed_fees": F.lit(True), "stamp_duty": F.lit(True), "vat_kind": F.lit("other"), "seller": F.lit("individual")}
    fields = [f.split() for f in D.INPUT.split(", ")]
    p = F.struct(*(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields))
    found = D.with_title_deed_fee(read(spark, d, "customer").select("c_custkey", p.alias("p")))
    return found.select("c_custkey", F.round("fee.total", 1).alias("total"), F.round("fee.seller_total", 1).alias("seller_total"))


@query("""WITH a AS (SELECT c_custkey, greatest(floor(c_acctbal) * 100, 0) AS c FROM customer), b AS (SELECT *, c * 0.199 AS first FROM a)
SELECT c_custkey, round(first + (c + first) * 0.2 + c * 0.06, 2) AS total FROM b""")
def vehicle_import(spark, d):
    given = {"cif": F.floor("c_acctbal") * 100, "fuel": F.lit("petrol"), "engine_cc": F.lit(1600), "origin": F.lit("other")}
    fields = [f.split() for f in V.INPUT.split(", ")]
    p = F.struct(*(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields))
    return V.with_vehicle_import(read(spark, d, "customer").select("c_custkey", p.alias("p"))).select("c_custkey", F.round("duty.total", 2).alias("total"))


@query("SELECT o_orderkey, DATE '2001-03-15' < (o_orderdate::DATE + INTERVAL 5 YEAR)::DATE AS allowed, greatest(2001 - year(o_orderdate) - CASE WHEN strftime(o_orderdate, '%m%d') > '0315' THEN 1 ELSE 0 END, 0)::INT AS age FROM orders")
def vehicle_age(spark, d):
    o = read(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    made = o.withColumn("a", V.age_check(F.col("day"), F.lit("2001-03-15").cast("date")))
    return made.select("o_orderkey", F.col("a.allowed").alias("allowed"), F.col("a.age_years").cast("int").alias("age"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}]+'))::BIGINT AS words, len(regexp_extract_all(text, '\(cid:[0-9]+\)'))::BIGINT AS glyphs, length(text) / 3.0::DOUBLE < 150 AS scanned FROM documents")
def extraction_counts(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", X.count_words(t).cast("long").alias("words"), X.count_glyphs(t).cast("long").alias("glyphs"), X.looks_scanned(t, F.lit(3), F.lit(0)).alias("scanned"))


@query(None)
def law_blocks(spark, d):
    """Headings and paragraphs of every document."""
    return read(spark, d, "documents").select("doc_id", F.posexplode(X.law_blocks(F.col("text"))).alias("place", "b")).select("doc_id", "place", "b.*")


@query(None)
def masked_titles(spark, d):
    """Every document's text as a title, split into levels, with the matches of a query on top."""
    return read(spark, d, "documents").select("doc_id", S.overlay_matches(Y.mask_title(F.col("text")), "the der").alias("tokens"))


@query(rf"""WITH {_DOCS}, c AS (SELECT doc_id, string_split(trim(regexp_replace(regexp_replace(regexp_replace(text, '[#*`|]', '', 'g'), '-{{2,}}', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g')), ' ') AS p FROM docs WHERE contains(t, ' the') AND contains(t, ' is')),
f AS (SELECT doc_id, p, list_transform(p, lambda w: regexp_replace({_FOLD.replace("coalesce(text, '')", "w")}, '[^a-z0-9]+', '', 'g')) AS w FROM c),
h AS (SELECT doc_id, p, w, list_transform(w, lambda x: starts_with(x, 'the')::INT + 2 * starts_with(x, 'is')::INT) AS bits FROM f),
one AS (SELECT doc_id, unnest(bits) AS b, generate_subscripts(bits, 1) AS pos FROM h),
hit AS (SELECT doc_id, pos, b FROM one WHERE b > 0),
near AS (SELECT x.doc_id, x.pos AS s, min(y.pos) FILTER (WHERE y.b & 1 > 0) AS a, min(y.pos) FILTER (WHERE y.b & 2 > 0) AS i FROM hit x JOIN hit y ON x.doc_id = y.doc_id AND y.pos BETWEEN x.pos AND x.pos + 39 GROUP BY ALL),
best AS (SELECT DISTINCT ON (doc_id) doc_id, s, greatest(coalesce(a, i), coalesce(i, a)) AS e FROM near ORDER BY doc_id, (a IS NULL)::INT + (i IS NULL)::INT, greatest(coalesce(a, i), coalesce(i, a)) - s, s),
grown AS (SELECT h.*, coalesce(s, 1) AS s, e, list_min(list_filter(range(greatest(1, s - (40 - (e - s + 1)) // 2), s + 1), lambda j: length(w[j]) > 3 OR bits[j] > 0 OR j = s)) AS l FROM h LEFT JOIN best USING (doc_id)),
ends AS (SELECT *, list_max(list_filter(range(e, least(len(p), l + 39) + 1), lambda j: length(w[j]) > 3 OR bits[j] > 0 OR j = e)) AS r FROM grown)
SELECT doc_id, CASE WHEN e IS NULL THEN array_to_string(p[1:20], ' ') ELSE array_to_string(list_transform(range(l, r + 1), lambda j: CASE WHEN bits[j] > 0 THEN '<' || p[j] || '>' ELSE p[j] END), ' ') END AS snippet FROM ends""")
def snippets(spark, d):
    """The best stretch of every document that matches, its matches in angle brackets."""
    hits = I.find(read(spark, d, "documents"), _postings(spark, d), "doc_id", "the is")
    return hits.select("doc_id", F.translate(S.snippet(F.col("text"), "the is"), "\u0001\u0002", "<>").alias("snippet"))


@query(None)
def headlines(spark, d):
    """The same as tokens with their levels."""
    hits = I.find(read(spark, d, "documents"), _postings(spark, d), "doc_id", "der")
    return hits.select("doc_id", S.headline_tokens(S.snippet(F.col("text"), "der")).alias("tokens"))


@query(None)
def summary_checks(spark, d):
    """Every turn of every conversation, checked as a summary of the one before."""
    c = read(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("summary"))
    pairs = c.join(c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("summary").alias("title")), ["conv_id", "turn"])
    return pairs.withColumn("c", Y.check_summary(F.col("title"), F.col("summary"))).select("conv_id", "turn", "c.*")

"""Queries of list, issue, law and sitemap pages, over records made of the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulary.functions import labels as LB
from tabulary.functions.params import TOPICS
from tabulary.operators import pages as P
from tabulary.sources.tables import read

QUERIES: dict = {}
SQL: dict[str, str] = {}
TODAY = "2000-06-01"

_TYPES = {"O": "tuzuk", "F": "genelge"}
_TOPIC_LIST = ", ".join(f"'{t}'" for t in TOPICS)
#: The same records, bridges, entities and laws as ``_tables`` makes.
_MADE = f"""
records AS (SELECT o_orderkey AS id, o_custkey AS issue_id, 'k-' || o_orderkey AS slug, o_totalprice > 150000 AS has_own_page, o_orderpriority || '-' || o_orderstatus || '_' || (o_custkey % 7) || '% tuzugu ve degisiklikleri hakkinda ' || (o_custkey % 500) AS title,
  NULL::VARCHAR AS summary, CASE o_orderstatus WHEN 'O' THEN 'tuzuk' WHEN 'F' THEN 'genelge' ELSE 'baska' END AS doc_type, CASE WHEN o_orderkey % 4 > 0 THEN 'ae' END AS ref_type, (o_orderkey % 900)::VARCHAR AS ref_number,
  o_orderdate::DATE AS published_at, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate::DATE + 10 END AS deadline_at, o_orderpriority AS section,
  CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN repeat('x', (o_orderkey % 400)::INT) END AS body_text, CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey - 1 END AS related_record_id, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey - 2 END AS corrects_id,
  CASE o_custkey % 4 WHEN 0 THEN 'khk' WHEN 1 THEN 'diger' END AS issuer, CASE WHEN o_custkey % 3 > 0 THEN 'ilk' END AS munhal_kind FROM orders),
issues AS (SELECT c_custkey AS id, 1996 + c_nationkey % 6 AS year, c_custkey AS number, DATE '1996-01-01' + (c_custkey % 1500)::INT AS published_at, CASE WHEN c_acctbal > 0 THEN c_acctbal / 10000 END AS text_quality FROM customer),
record_topics AS (SELECT DISTINCT l_orderkey AS record_id, ([{_TOPIC_LIST}, 'baska'])[l_partkey % 11 + 1] AS topic FROM lineitem),
record_entities AS (SELECT l_orderkey AS record_id, l_suppkey AS entity_id, max(l_discount) AS confidence FROM lineitem GROUP BY ALL),
entities AS (SELECT s_suppkey AS id, (['institution', 'company', 'place'])[s_nationkey % 3 + 1] AS kind, 's-' || s_suppkey AS slug, s_name AS name, count(record_id) AS record_count FROM supplier LEFT JOIN record_entities ON entity_id = s_suppkey GROUP BY ALL),
laws AS (SELECT p_partkey AS law_key, 'l-' || p_partkey AS slug, CASE WHEN p_size % 2 = 0 THEN 'yasa' ELSE 'tuzuk' END AS kind, lower(p_name) AS title_normalized, CASE WHEN p_size > 10 THEN 1950 + p_size END AS law_year, CASE WHEN p_size > 5 THEN p_partkey % 90 END AS law_number,
  CASE WHEN p_partkey % 13 = 0 THEN 'en' ELSE 'tr' END AS lang, CASE WHEN p_partkey % 17 = 0 THEN 'empty' ELSE 'ok' END AS extract_status, CASE WHEN p_partkey % 3 = 0 THEN DATE '2001-01-01' + p_size END AS body_modified_at FROM part)"""


def _tables(spark, d) -> dict:
    o, c, li, s, p = (read(spark, d, t) for t in ("orders", "customer", "lineitem", "supplier", "part"))
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    records = o.select(
        key.alias("id"), F.col("o_custkey").alias("issue_id"), F.concat(F.lit("k-"), key).alias("slug"), (F.col("o_totalprice") > 150000).alias("has_own_page"),
        F.concat("o_orderpriority", F.lit("-"), "o_orderstatus", F.lit("_"), F.col("o_custkey") % 7, F.lit("% tuzugu ve degisiklikleri hakkinda "), F.col("o_custkey") % 500).alias("title"), F.lit(None).cast("string").alias("summary"),
        F.when(F.col("o_orderstatus") == "O", "tuzuk").when(F.col("o_orderstatus") == "F", "genelge").otherwise("baska").alias("doc_type"), F.when(key % 4 > 0, "ae").alias("ref_type"), (key % 900).cast("string").alias("ref_number"),
        day.alias("published_at"), F.when(key % 5 == 0, F.date_add(day, 10)).alias("deadline_at"), F.col("o_orderpriority").alias("section"),
        F.when(key % 3 == 0, "").when(key % 3 == 1, F.repeat(F.lit("x"), (key % 400).cast("int"))).alias("body_text"), F.when(key % 9 == 0, key - 1).alias("related_record_id"), F.when(key % 11 == 0, key - 2).alias("corrects_id"),
        F.when(F.col("o_custkey") % 4 == 0, "khk").when(F.col("o_custkey") % 4 == 1, "diger").alias("issuer"), F.when(F.col("o_custkey") % 3 > 0, "ilk").alias("munhal_kind"))
    quality = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 10000)
    issues = c.select(F.col("c_custkey").alias("id"), (1996 + F.col("c_nationkey") % 6).alias("year"), F.col("c_custkey").alias("number"), F.date_add(F.lit("1996-01-01").cast("date"), (F.col("c_custkey") % 1500).cast("int")).alias("published_at"), quality.alias("text_quality"))
    names = F.array(*map(F.lit, (*TOPICS, "baska")))
    topics = li.select(F.col("l_orderkey").alias("record_id"), F.get(names, (F.col("l_partkey") % 11).cast("int")).alias("topic")).distinct()
    links = li.groupBy(F.col("l_orderkey").alias("record_id"), F.col("l_suppkey").alias("entity_id")).agg(F.max("l_discount").alias("confidence"))
    counts = links.groupBy(F.col("entity_id").alias("s_suppkey")).agg(F.count("*").alias("record_count"))
    kinds = F.array(*map(F.lit, ("institution", "company", "place")))
    entities = s.join(counts, "s_suppkey", "left").select(F.col("s_suppkey").alias("id"), F.get(kinds, F.col("s_nationkey") % 3).alias("kind"), F.concat(F.lit("s-"), "s_suppkey").alias("slug"), F.col("s_name").alias("name"), F.coalesce("record_count", F.lit(0).cast("long")).alias("record_count"))
    part = F.col("p_partkey")
    laws = p.select(part.alias("law_key"), F.concat(F.lit("l-"), part).alias("slug"), F.when(F.col("p_size") % 2 == 0, "yasa").otherwise("tuzuk").alias("kind"), F.lower("p_name").alias("title_normalized"), F.when(F.col("p_size") > 10, 1950 + F.col("p_size")).alias("law_year"),
                    F.when(F.col("p_size") > 5, part % 90).alias("law_number"), F.when(part % 13 == 0, "en").otherwise("tr").alias("lang"), F.when(part % 17 == 0, "empty").otherwise("ok").alias("extract_status"), F.when(part % 3 == 0, F.date_add(F.lit("2001-01-01").cast("date"), F.col("p_size"))).alias("body_modified_at"))
    return {"records": records, "issues": issues, "record_topics": topics, "record_entities": links, "entities": entities, "laws": laws}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = (lambda spark, d: f(_tables(spark, d))), f"WITH {_MADE}{sql}"
        return f

    return put


_ROWS = """, t AS (SELECT record_id AS id, string_agg(topic, '|' ORDER BY topic) AS topics FROM record_topics GROUP BY 1),
inst AS (SELECT DISTINCT ON (record_id) record_id AS id, name FROM record_entities JOIN entities e ON e.id = entity_id WHERE kind = 'institution' ORDER BY record_id, confidence DESC, record_count DESC, entity_id),
rows AS (SELECT r.id, r.slug, r.has_own_page, r.title, r.summary, r.doc_type, r.ref_type, r.ref_number, r.published_at, r.deadline_at, i.year AS issue_year, i.number AS issue_number, coalesce(t.topics, '') AS topics, inst.name AS institution, coalesce(length(body_text) > 0, false) AS has_body
FROM records r LEFT JOIN issues i ON i.id = r.issue_id LEFT JOIN t ON t.id = r.id LEFT JOIN inst ON inst.id = r.id)"""


def _list_rows(t):
    return P.list_rows(t["records"], t["issues"], t["record_topics"], t["record_entities"], t["entities"])


@query(_ROWS + " SELECT * FROM rows")
def list_projection(t):
    return _list_rows(t).withColumn("topics", F.array_join("topics", "|"))


@query(_ROWS + f""" SELECT id, CASE doc_type WHEN 'tuzuk' THEN 'Tüzük' WHEN 'genelge' THEN 'Genelge' ELSE 'Diğer' END AS doc_type_label, CASE WHEN ref_type = 'ae' THEN 'A.E. ' || ref_number END AS ref_label, strftime(published_at, '%Y-%m-%d') AS published_at,
list_filter([{_TOPIC_LIST}], lambda x: list_contains(string_split(topics, '|'), x))[1] AS primary_topic,
CASE WHEN has_own_page OR issue_year IS NULL THEN '/karar/' || slug ELSE '/sayilar/' || issue_year || '/' || issue_number || coalesce('#karar-A.E.%20' || CASE WHEN ref_type = 'ae' THEN ref_number END, '') END AS address FROM rows""")
def list_items(t):
    return P.list_items(_list_rows(t)).select("id", "doc_type_label", "ref_label", "published_at", "primary_topic", "address")


@query(""" SELECT id FROM records r WHERE has_own_page AND EXISTS (SELECT 1 FROM record_topics WHERE record_id = r.id AND topic IN ('ihale', 'marka')) AND EXISTS (SELECT 1 FROM record_entities JOIN entities e ON e.id = entity_id WHERE record_id = r.id AND e.slug IN ('s-3'))
AND doc_type IN ('tuzuk', 'genelge') AND published_at >= DATE '1996-03-01' AND published_at <= DATE '2000-12-31'""")
def list_filters(t):
    return P.list_filter(t["records"], t["record_topics"], t["record_entities"], t["entities"], topics=("ihale", "marka"), doc_types=("tuzuk", "genelge"), entity_slug="s-3", begin="1996-03-01", end="2000-12-31").select("id")


@query(f""" SELECT id FROM records WHERE has_own_page AND deadline_at IS NOT NULL AND deadline_at >= DATE '{TODAY}' AND issuer = 'khk' AND munhal_kind = 'ilk'
UNION ALL SELECT id FROM records WHERE has_own_page AND deadline_at IS NOT NULL AND deadline_at < DATE '{TODAY}' AND year(published_at) = 1998 AND issuer = 'diger'""")
def list_filters_of_notices(t):
    """Open vacancies of one issuer, and one year's closed notices of another."""
    rows = lambda **given: P.list_filter(t["records"], t["record_topics"], t["record_entities"], t["entities"], today=F.lit(TODAY).cast("date"), **given).select("id")
    return rows(deadline="open", issuer="khk", vacancy="ilk").unionByName(rows(deadline="closed", year=1998, issuer="diger"))


@query(_ROWS + """ SELECT id, slug FROM rows WHERE has_own_page AND year(published_at) = 1999 AND id IN (SELECT record_id FROM record_topics WHERE topic = 'ihale') ORDER BY published_at DESC, id DESC LIMIT 20 OFFSET 20""")
def topic_page(t):
    """The second page of a topic's list."""
    kept = P.list_filter(t["records"], t["record_topics"], t["record_entities"], t["entities"], topics=("ihale",), year=1999).select("id")
    return P.list_page(_list_rows(t).join(kept, "id", "left_semi"), [F.desc("published_at"), F.desc("id")], 20, 20).select("id", "slug")


@query(r""" SELECT id FROM records WHERE contains(title, 'F_3%')""")
def like_escaped(t):
    return t["records"].where(P.contains_text(F.col("title"), "F_3%")).select("id")


@query(" SELECT i.id, i.year, i.number, count(r.id) AS record_count FROM issues i LEFT JOIN records r ON r.issue_id = i.id GROUP BY ALL")
def issue_counts(t):
    return P.issue_rows(t["issues"], t["records"]).select("id", "year", "number", "record_count")


@query(" SELECT issue_id, section, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM records GROUP BY ALL")
def issue_sections(t):
    return P.issue_sections(t["records"]).withColumn("ids", F.array_join("ids", ","))


@query(" SELECT year, round(avg(text_quality), 9) AS quality FROM issues WHERE text_quality IS NOT NULL GROUP BY 1")
def year_quality(t):
    return P.year_quality(t["issues"]).withColumn("quality", F.round("quality", 9))


@query(f""", i AS (SELECT * FROM issues ORDER BY published_at DESC, number DESC, id LIMIT 1) SELECT (SELECT count(*) FROM records WHERE published_at = DATE '{TODAY}') AS today, (SELECT count(*) FROM records) AS total, year, number, (SELECT count(*) FROM records WHERE issue_id = i.id) AS record_count FROM i""")
def status_page(t):
    return P.site_status(t["records"].withColumn("created_at", F.col("published_at")), t["issues"], F.lit(TODAY).cast("date"))


@query(" SELECT id, name, record_count FROM entities WHERE kind = 'company' AND record_count >= 2 ORDER BY record_count DESC, name, id LIMIT 20")
def top_entities(t):
    return P.listed_entities(t["entities"], "company", 20).select("id", "name", "record_count")


@query(" SELECT id, slug FROM entities WHERE kind = 'place' AND record_count >= 2 ORDER BY record_count DESC, name, id LIMIT 10 OFFSET 5")
def entity_page(t):
    return P.listed_entities(t["entities"], "place", 10, 5).select("id", "slug")


@query(" SELECT slug FROM entities WHERE kind = 'institution' AND record_count >= 2")
def entity_slugs(t):
    return P.listed_entities(t["entities"], "institution").select("slug")


@query(" SELECT kind, count(*) AS total FROM entities WHERE record_count >= 2 GROUP BY 1")
def entity_totals(t):
    return P.count_entities(t["entities"])


@query(" SELECT law_key, slug FROM laws WHERE kind = 'yasa' AND lang = 'tr' AND extract_status = 'ok'")
def law_list(t):
    return P.listed_laws(t["laws"], "yasa").select("law_key", "slug")


@query(" SELECT law_key, law_year FROM laws ORDER BY law_year DESC NULLS LAST, law_number DESC NULLS LAST, title_normalized, law_key LIMIT 400")
def newest_laws(t):
    return P.newest_laws(t["laws"], 400).select("law_key", "law_year")


@query(" SELECT CASE id % 4 WHEN 0 THEN 'rule' WHEN 1 THEN 'llm' ELSE 'declined' END AS source, CASE WHEN id % 4 > 1 THEN coalesce(CASE WHEN id % 7 > 0 THEN section END, 'unknown') END AS declined_by, count(*) AS groups, sum(id % 5)::BIGINT AS records FROM records GROUP BY 1, 2")
def run_statistics(t):
    kind = F.col("id") % 4
    made = t["records"].select(F.when(kind == 0, "rule").when(kind == 1, "llm").otherwise("declined").alias("source"), F.when(F.col("id") % 7 > 0, F.col("section")).alias("reason"), (F.col("id") % 5).alias("n"))
    return P.run_statistics(made)


@query(" SELECT r.id, length(coalesce(body_text, '')) >= 200 OR count(entity_id) > 0 AS own FROM records r LEFT JOIN record_entities ON record_id = r.id AND r.id % 2 = 0 GROUP BY r.id, body_text")
def thin_records(t):
    n = t["record_entities"].where("record_id % 2 = 0").groupBy(F.col("record_id").alias("id")).agg(F.count("*").alias("n"))
    return t["records"].join(n, "id", "left").select("id", P.has_own_page(F.col("body_text"), F.col("n")).alias("own"))


@query(" SELECT id, EXISTS (SELECT 1 FROM record_topics WHERE record_id = id AND topic = 'ihale') OR (doc_type = 'genelge' AND EXISTS (SELECT 1 FROM record_topics WHERE record_id = id AND topic = 'munhal')) AS due FROM records")
def deadline_carriers(t):
    found = t["record_topics"].groupBy(F.col("record_id").alias("id")).agg(F.collect_set("topic").alias("topics"))
    rows = t["records"].join(found, "id", "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))
    return rows.select("id", P.carries_deadline(F.col("doc_type"), F.col("topics")).alias("due"))


@query(" SELECT record_id, unnest(list(topic ORDER BY topic)) AS topic, unnest(range(1, 3)) AS place FROM record_topics GROUP BY 1")
def parallel_arrays(t):
    rows = t["record_topics"].groupBy("record_id").agg(F.array_sort(F.collect_list("topic")).alias("topic"), F.array(F.lit(1).cast("long"), F.lit(2).cast("long")).alias("place"))
    return P.unnested(rows, ["record_id"], ["topic", "place"])


@query(""", q AS (SELECT id FROM issues WHERE text_quality IS NULL ORDER BY published_at DESC, id DESC LIMIT 5) SELECT i.id, CASE WHEN q.id IS NOT NULL THEN 1.0::DOUBLE ELSE round(text_quality, 9) END AS text_quality FROM issues i LEFT JOIN q ON q.id = i.id""")
def reading_queue(t):
    queue = P.reading_queue(t["issues"], "text_quality")
    return P.mark_read(t["issues"], queue, "text_quality", F.lit(1.0)).select("id", F.round("text_quality", 9).alias("text_quality"))


@query(""", m AS (SELECT a.id AS of_id, max(r.id) AS id, r.published_at FROM (SELECT *, regexp_extract(title, '[^-]*$') AS e FROM records WHERE doc_type = 'tuzuk') a JOIN records r ON r.doc_type = 'tuzuk' AND r.has_own_page AND r.id <> a.id AND r.published_at <> a.published_at AND length(e) > 25 AND suffix(r.title, e) GROUP BY a.id, r.published_at)
SELECT of_id, id, published_at FROM m QUALIFY row_number() OVER (PARTITION BY of_id ORDER BY published_at DESC) <= 8""")
def other_amendments(t):
    records = t["records"].withColumn("title_normalized", F.col("title"))
    return P.other_amendments(records, records)


@query(""", e AS (SELECT record_id AS id, 'entities' AS kind, entity_id AS other FROM record_entities JOIN entities en ON en.id = entity_id QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY confidence DESC, record_count DESC, entity_id) <= 12),
p AS (SELECT id, related_record_id AS other FROM records WHERE related_record_id IS NOT NULL UNION SELECT related_record_id, id FROM records WHERE related_record_id IS NOT NULL),
s AS (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY b.section, b.id) AS n FROM records a JOIN records b ON a.issue_id = b.issue_id AND a.id <> b.id AND b.has_own_page)
SELECT * FROM e UNION ALL SELECT id, 'related', other FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY other) <= 5
UNION ALL SELECT corrects_id, 'corrections', id FROM records WHERE corrects_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY corrects_id ORDER BY published_at DESC, id) <= 5 UNION ALL SELECT id, 'same_issue', other FROM s WHERE n <= 8""")
def detail_fan_out(t):
    return P.fan_out(t["records"], t["record_entities"], t["entities"])


@query(f""", o AS (SELECT '/karar/' || slug AS path, published_at AS day, id, published_at > DATE '{TODAY}' - INTERVAL 6 MONTH AS new FROM records WHERE has_own_page),
e AS (SELECT *, row_number() OVER (PARTITION BY new ORDER BY day DESC, id DESC) - 1 AS n FROM o),
s AS (SELECT unnest([{", ".join(f"{{'path': '{p}', 'w': {w}, 'o': '{o}', 'd': {'true' if d else 'false'}}}" for p, w, o, d in (*P.FIXED_PAGES, *((f"/konu/{t}", 0.8, "daily", True) for t in TOPICS)))}], recursive := true))
SELECT 0 AS chunk, 0 AS file, path, CASE WHEN d THEN DATE '{TODAY}' END AS lastmod, w::DOUBLE AS priority, o AS changefreq FROM s
UNION ALL SELECT CASE WHEN new THEN 1 ELSE 5 END, CASE WHEN new THEN 0 ELSE n // 45000 END::INT, path, day, CASE WHEN new THEN 0.8 ELSE 0.3 END, CASE WHEN new THEN 'monthly' ELSE 'yearly' END FROM e WHERE NOT new OR n < 45000
UNION ALL SELECT 2, 0, '/sayilar/' || year || '/' || number, published_at, 0.4, 'yearly' FROM issues UNION ALL SELECT DISTINCT 2, 0, '/sayilar/' || year, NULL::DATE, CASE WHEN year >= 1999 THEN 0.6 ELSE 0.3 END, CASE WHEN year >= 2000 THEN 'weekly' ELSE 'yearly' END FROM issues
UNION ALL SELECT 3, 0, CASE kind WHEN 'institution' THEN '/kurum/' WHEN 'company' THEN '/sirket/' ELSE '/yer/' END || slug, NULL, CASE WHEN record_count > 20 THEN 0.6 ELSE 0.4 END, 'monthly' FROM entities WHERE record_count >= 2
UNION ALL SELECT DISTINCT 4, 0, '/konu/' || topic || '/' || year(published_at) + 22, NULL, 0.6, 'weekly' FROM record_topics JOIN records ON id = record_id WHERE topic <> 'baska' AND year(published_at) + 22 >= 2020
UNION ALL SELECT 6, 0, '/' || kind || '/' || slug, body_modified_at, 0.7, 'monthly' FROM laws WHERE lang = 'tr' AND extract_status = 'ok'""")
def sitemap_entries(t):
    years = t["record_topics"].join(t["records"].select(F.col("id").alias("record_id"), (F.year("published_at") + 22).alias("year")), "record_id").select("topic", "year").distinct()
    return P.sitemap_entries(t["records"], t["issues"], t["entities"], years, t["laws"], F.lit(TODAY).cast("date"))


@query(""", w AS (SELECT id, (id % 12 + 1)::INT AS page, (id % 40)::INT AS total FROM records), n AS (SELECT *, list_sort(list_distinct(list_filter([1, page - 1, page, page + 1, total], lambda x: x >= 1 AND x <= total))) AS near FROM w)
SELECT id, CASE WHEN total <= 7 THEN array_to_string(range(1, total + 1), ' ') ELSE array_to_string(list_transform(near, lambda x, i: CASE WHEN i > 1 AND x - near[i - 1] > 1 THEN '. ' ELSE '' END || x), ' ') END AS pages FROM n""")
def page_windows(t):
    window = P.page_window((F.col("id") % 12 + 1).cast("int"), (F.col("id") % 40).cast("int"))
    return t["records"].select("id", F.array_join(window, " ", ".").alias("pages"))


@query(""", x AS (SELECT id, id % 100000 || ',' || (id % 1000) AS typed FROM records), y AS (SELECT id, regexp_replace(string_split(typed, ',')[1], '\\D', '', 'g') || '.' || left(string_split(typed, ',')[2], 2) AS canonical FROM x)
SELECT id, canonical, regexp_replace(reverse(regexp_replace(reverse(string_split(canonical, '.')[1]), '(\\d{3})', '\\1.', 'g')), '^\\.', '') || ',' || string_split(canonical, '.')[2] AS shown FROM y""")
def number_inputs(t):
    canonical = LB.canonical_number(F.concat((F.col("id") % 100000).cast("string"), F.lit(","), (F.col("id") % 1000).cast("string")))
    return t["records"].select("id", canonical.alias("canonical")).withColumn("shown", LB.number_input(F.col("canonical")))


@query(r""" SELECT id, id % 3 = 1 AS amending FROM records""")
def amending_titles(t):
    n = F.col("id") % 3
    return t["records"].select("id", P.amends(F.concat(F.col("title"), F.when(n == 0, " İPTAL KARARI").when(n == 1, " TADİL  EDİLMESİ").otherwise(" iptal edilmesi"))).alias("amending"))


@query(""" SELECT id, strftime(published_at, '%Y-%m-%d') AS letterhead FROM records""")
def letterhead_dates(t):
    months = F.array(*map(F.lit, ("Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık")))
    date = F.concat_ws(" ", F.dayofmonth("published_at").cast("string"), F.get(months, F.month("published_at") - 1), F.year("published_at").cast("string"))
    text = F.concat(F.lit("KKTC\nKAMU HİZMETİ KOMİSYONU\nSayı : KHK.0.00-001/07-26/E.5154   "), date, F.repeat(F.lit("\nsatır"), 40), F.lit("\n1 Mart 1990"))
    return t["records"].select("id", LB.letterhead_date(text).alias("letterhead"))

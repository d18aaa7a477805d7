"""Archive queries on the driver's tables: one entry per operator, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulary.functions import labels as LB
from tabulary.functions import text as T
from tabulary.operators import index as I
from tabulary.operators import linking as K
from tabulary.operators import lists as L
from tabulary.operators import merge as M
from tabulary.operators import pages as P
from tabulary.operators import search as S
from tabulary.operators import versions as V
from tabulary.sources.stored import derived, scratch
from tabulary.sources.tables import read

QUERIES: dict = {}
SQL: dict[str, str] = {}
TODAY = "2000-06-01"


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


_FOLD = "translate(lower(translate(coalesce(text, ''), 'İI', 'iı')), 'çğıöşüâîûàáãäåèéêëìíïñòóõúùýÿ', 'cgiosuaiuaaaaaeeeeiiinooouuyy')"
_DOCS = f"docs AS (SELECT *, ' ' || trim(regexp_replace({_FOLD}, '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents)"


def _docs(spark, d):
    """Documents with their folded text, which is stored once for all searches."""
    fold = lambda rows: rows.select("doc_id", "lang", "source", "n_chars", S.search_text(F.col("text")).alias("t"))
    return derived(spark, "search", read(spark, d, "documents"), fold)


def _postings(spark, d):
    """The words of those texts with their places, stored by first letter."""
    return derived(spark, "postings", read(spark, d, "documents"), lambda rows: I.postings(rows.select("doc_id", S.search_text(F.col("text")).alias("t")), "doc_id", "t"), by="head")


def _facts(spark, d):
    return read(spark, d, "documents").drop("text")


def _found(spark, d, asked):
    """Documents that match, with strict and direct, and without their texts."""
    return I.find(_facts(spark, d), _postings(spark, d), "doc_id", asked)


@query(f"WITH {_DOCS} SELECT doc_id, lang FROM docs WHERE contains(t, ' tion')")
def search_prefix(spark, d):
    return _found(spark, d, "tion").where("strict").select("doc_id", "lang")


@query(rf"WITH {_DOCS} SELECT doc_id FROM docs WHERE regexp_matches(t, ' (the[^ ]*( [^ ]+){{0,2}} and[^ ]*|and[^ ]*( [^ ]+){{0,2}} the[^ ]*) ')")
def search_proximity(spark, d):
    return _found(spark, d, "the and").where("strict").select("doc_id")


@query(f"WITH {_DOCS} SELECT doc_id FROM docs WHERE NOT contains(t, ' the') OR regexp_matches(t, ' (koca|ocak)[^ ]* ')")
def search_without_words(spark, d):
    """What holds for texts that have no word of the query."""
    return _found(spark, d, "-the OR koca OR ocak").where("strict").select("doc_id")


@query(f"WITH {_DOCS} SELECT doc_id FROM docs WHERE regexp_matches(t, ' of[^ ]* the[^ ]* ')")
def search_phrase(spark, d):
    return _found(spark, d, '"of the"').where("strict").select("doc_id")


@query(f"WITH {_DOCS} SELECT doc_id FROM docs WHERE contains(t, ' der') OR (contains(t, ' les') AND NOT contains(t, ' que'))")
def search_or_not(spark, d):
    return _found(spark, d, "der OR les -que").where("strict").select("doc_id")


@query(f"WITH {_DOCS} SELECT doc_id FROM docs WHERE regexp_matches(t, ' (tuzuk[^ ]*|yonetmelik[^ ]*|tuzug[^ ]*) ') OR contains(t, ' para')")
def search_synonym(spark, d):
    return _found(spark, d, "tüzük OR para").select("doc_id")


@query(rf"""WITH {_DOCS} SELECT doc_id, lang, CAST(contains(t, ' the') AND contains(t, ' is') AS INT) AS tier FROM docs
WHERE regexp_matches(t, ' (the[^ ]*( [^ ]+){{0,2}} is[^ ]*|is[^ ]*( [^ ]+){{0,2}} the[^ ]*) ') ORDER BY tier DESC, n_chars DESC, doc_id LIMIT 20""")
def search_tiered_topk(spark, d):
    return I.tiered_page(_facts(spark, d), _postings(spark, d), "doc_id", "the is", [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "lang", "tier")


@query(f"""WITH {_DOCS}, hits AS (SELECT * FROM docs WHERE contains(t, ' an'))
SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM hits WHERE source IN ('src0', 'src1', 'src2') GROUP BY lang
UNION ALL SELECT 'source', source, count(*) FROM hits WHERE lang IN ('en', 'de') GROUP BY source""")
def search_facets(spark, d):
    hits = _found(spark, d, "an").where("strict").select("lang", "source")
    return S.facets(hits, {"lang": ["en", "de"], "source": ["src0", "src1", "src2"]})


@query("SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents WHERE lang IN ('fr') GROUP BY source")
def facets_without_query(spark, d):
    return S.facets(read(spark, d, "documents").select("lang", "source"), {"lang": ["fr"], "source": []})


@query(f"WITH {_DOCS}, hits AS (SELECT 1 FROM docs WHERE contains(t, ' the') LIMIT 10000) SELECT count(*) AS total, count(*) >= 10000 AS capped FROM hits")
def capped_count(spark, d):
    return S.capped_count(_found(spark, d, "the").where("strict").select("doc_id"))


@query(rf"""WITH {_DOCS} SELECT greatest(0, least(10000, count(*) FILTER (WHERE contains(t, ' the') AND contains(t, ' be')))
 - least(10000, count(*) FILTER (WHERE regexp_matches(t, ' (the[^ ]*( [^ ]+){{0,2}} be[^ ]*|be[^ ]*( [^ ]+){{0,2}} the[^ ]*) ')))) AS extra FROM docs""")
def loose_extra(spark, d):
    return I.loose_extra(_facts(spark, d), _postings(spark, d), "doc_id", "the be")


@query(f"SELECT o_orderkey, CASE WHEN o_orderdate::DATE > DATE '{TODAY}' - 90 THEN 1.5 WHEN o_orderdate::DATE > DATE '{TODAY}' - 365 THEN 1.2 ELSE 1.0 END::DOUBLE AS boost FROM orders")
def recency_boost(spark, d):
    o = read(spark, d, "orders")
    return o.select("o_orderkey", S.recency_boost(F.col("o_orderdate").cast("date"), F.lit(TODAY).cast("date")).cast("double").alias("boost"))


_TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


@query(f"""WITH s AS (SELECT p_partkey, p_name, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS similarity
FROM (SELECT p_partkey, p_name, {_TRI.format(x='p_name')} AS a, {_TRI.format(x="'smal ringg'")} AS b FROM part))
SELECT p_partkey, round(similarity, 9) AS similarity FROM s WHERE similarity > 0.3 ORDER BY similarity DESC, p_partkey DESC LIMIT 1""")
def trigram_suggest(spark, d):
    parts = read(spark, d, "part")
    stored = derived(spark, "part_trigrams", parts, lambda rows: I.trigram_postings(rows, "p_partkey", "p_name"), by="bucket")
    found = I.suggest(parts, stored, "p_partkey", "Smal ringg", [F.desc("p_partkey")])
    return found.select("p_partkey", F.round("similarity", 9).alias("similarity"))


@query(f"""WITH n AS (SELECT c_custkey, lower(c_name) AS name FROM customer), c AS (SELECT o_custkey, count(*) AS record_count FROM orders GROUP BY 1),
s AS (SELECT c_custkey, name, record_count, {_TRI.format(x='name')} AS a, {_TRI.format(x="'customer#000000001'")} AS b FROM n JOIN c ON c_custkey = o_custkey)
SELECT c_custkey, name, record_count FROM s WHERE record_count >= 2 AND (contains(name, 'customer#000000001') OR len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) > 0.3)
ORDER BY starts_with(name, 'customer#000000001') DESC, contains(name, 'customer#000000001') DESC, record_count DESC, name LIMIT 8""")
def entity_search(spark, d):
    counts = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("record_count"))
    names = read(spark, d, "customer").select("c_custkey", F.lower("c_name").alias("name")).join(counts, F.col("c_custkey") == F.col("o_custkey"))
    stored = derived(spark, "customer_trigrams", read(spark, d, "customer"), lambda rows: I.trigram_postings(rows.withColumn("name", F.lower("c_name")), "c_custkey", "name"), by="bucket")
    return I.entity_search(names, stored, "c_custkey", "name", "record_count", "Customer#000000001").select("c_custkey", "name", "record_count")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name || ' ' || p_type), '(^|[^a-z0-9])hot') AND regexp_matches(lower(p_name || ' ' || p_type), '(^|[^a-z0-9])ge') ORDER BY starts_with(lower(p_name), 'hot ge') DESC, p_partkey LIMIT 25")
def law_filter(spark, d):
    return S.law_filter(read(spark, d, "part"), "p_name", "p_type", "Hot ge", [F.col("p_partkey")]).limit(25).select("p_partkey", "p_name")


_NORM = "trim(regexp_replace(translate(lower(translate(text, 'İI', 'iı')), 'çğıöşüâîû', 'cgiosuaiu'), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {_NORM} AS folded FROM documents")
def fold_normalize(spark, d):
    return read(spark, d, "documents").select("doc_id", T.normalize(F.col("text")).alias("folded"))


@query("""WITH b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(translate(lower(translate(text, 'İI', 'iı')), 'çğıöşüâîû', 'cgiosuaiu'), '[''’‘`´]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS b FROM documents),
c AS (SELECT doc_id, b, left(b, 80) AS c, regexp_extract(left(b, 80), '^(.*)-[^-]*$', 1) AS h FROM b)
SELECT doc_id, CASE WHEN length(b) <= 80 THEN b WHEN contains(c, '-') AND length(h) > 48 THEN h ELSE c END AS slug FROM c""")
def slugify(spark, d):
    return read(spark, d, "documents").select("doc_id", T.slugify(F.col("text")).alias("slug"))


@query(r"""SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<br\s*/?>', chr(10), 'gi'), '</(p|div|tr|li|td)>', chr(10), 'gi'), '<[^>]+>', ' ', 'g'),
'&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''') AS plain FROM pages""")
def strip_html(spark, d):
    return read(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("plain"))


@query("""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages""")
def link_discovery(spark, d):
    return read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("link")).distinct()


@query("SELECT doc_id, CASE WHEN length(trim(text)) > 200 THEN left(trim(text), 200) || '…' WHEN trim(text) = '' THEN NULL ELSE trim(text) END AS lead_in FROM documents")
def lead_in_snippet(spark, d):
    return read(spark, d, "documents").select("doc_id", T.lead_in(F.col("text")).alias("lead_in"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(translate(text, 'İI', 'iı')), '[^a-zçğıöşü]+'), lambda x: length(x) >= 3) AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) >= 20 THEN round(len(list_filter(w, lambda x: regexp_matches(x, '[aeıioöuü]') AND NOT regexp_matches(x, '[bcçdfgğhjklmnprsştvyz]{4}') AND NOT regexp_matches(x, '[qwx]')))::DOUBLE / len(w), 9) END AS quality FROM w""")
def text_quality(spark, d):
    return read(spark, d, "documents").select("doc_id", F.round(T.text_quality(F.col("text")), 9).alias("quality"))


@query("""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[A-ZÇĞÖŞÜ]{2,}i[A-ZÇĞÖŞÜ]')) AS n, length(text) AS len FROM documents)
SELECT doc_id, n::BIGINT AS damaged, CASE WHEN len > 0 THEN round(n * 10000.0::DOUBLE / len, 6) ELSE 0 END AS rate, (CASE WHEN len > 0 THEN n * 10000.0::DOUBLE / len ELSE 0 END >= 2 OR n >= 15) AS reread FROM c""")
def corruption_rate(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", T.corruption_count(t).cast("long").alias("damaged"), F.round(T.corruption_rate(t), 6).alias("rate"), T.needs_reread(t).alias("reread"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority IN ('1-URGENT', '2-HIGH'))")
def semi_filter(spark, d):
    o = read(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return L.having_any(read(spark, d, "customer"), o, "c_custkey", [F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")]).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_join(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey % 7 = 1)
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)""")
def multi_entity_filter(spark, d):
    li = read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    tests = [F.col("l_returnflag") == "R", F.col("l_suppkey") % 7 == 1, F.col("l_quantity") > 40]
    return L.having_any(read(spark, d, "orders"), li, "o_orderkey", tests).select("o_orderkey")


@query("SELECT c_custkey, coalesce((SELECT string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) FROM orders WHERE o_custkey = c_custkey), '') AS labels FROM customer")
def lateral_topics(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return L.with_labels(read(spark, d, "customer"), o, "c_custkey", "o_orderpriority", "labels").select("c_custkey", F.array_join("labels", "|").alias("labels"))


@query("SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1) AS best FROM customer")
def lateral_top1(spark, d):
    o = read(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return L.with_best(read(spark, d, "customer"), o, "c_custkey", "o_orderkey", ["o_totalprice", "o_orderkey"], "best").select("c_custkey", "best")


@query("SELECT DISTINCT ON (o_custkey, o_orderstatus) o_custkey, o_orderstatus, o_orderkey FROM orders ORDER BY o_custkey, o_orderstatus, o_orderdate DESC, o_orderkey DESC")
def distinct_on(spark, d):
    return L.first_per(read(spark, d, "orders"), ["o_custkey", "o_orderstatus"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderstatus", "o_orderkey")


@query("SELECT b.l_suppkey, count(DISTINCT a.l_partkey) AS n FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = 1 AND b.l_suppkey <> 1 GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 8")
def co_occurrence(spark, d):
    return L.co_occurring(read(spark, d, "lineitem").select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey", F.lit(1), 8)


@query("""SELECT l.o_orderkey, (SELECT e.o_orderkey FROM orders e WHERE e.o_custkey = l.o_custkey AND e.o_orderstatus = 'F' AND e.o_orderdate < l.o_orderdate ORDER BY e.o_orderdate DESC, e.o_orderkey DESC LIMIT 1) AS source_id
FROM orders l WHERE l.o_orderstatus = 'O'""")
def theta_self_join(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return L.earlier_match(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_orderkey", "source_id")


@query("""SELECT p_partkey, p_size FROM (SELECT DISTINCT ON (p_size) p_size, p_partkey FROM part WHERE p_brand || '-' || p_name LIKE '%small ring' ORDER BY p_size, p_partkey DESC) ORDER BY p_size DESC LIMIT 8""")
def suffix_join(spark, d):
    titled = read(spark, d, "part").withColumn("title", F.concat_ws("-", "p_brand", "p_name"))
    found = L.ending_like(titled, "title", "Brand#2-small ring", least=8)
    return L.first_per(found, ["p_size"], [F.desc("p_partkey")]).orderBy(F.desc("p_size")).limit(8).select("p_partkey", "p_size")


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN (SELECT lang, source, max(quality) AS quality FROM documents JOIN labels USING (doc_id) GROUP BY lang, source) l ON d.lang IS NOT DISTINCT FROM l.lang AND d.source IS NOT DISTINCT FROM l.source")
def null_safe_reuse(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang", "source")
    known = docs.join(read(spark, d, "labels"), "doc_id").groupBy("lang", "source").agg(F.max("quality").alias("quality")).alias("l")
    same = F.col("d.lang").eqNullSafe(F.col("l.lang")) & F.col("d.source").eqNullSafe(F.col("l.source"))
    return docs.alias("d").join(known, same, "left").select("d.doc_id", "d.lang", "l.quality")


@query("SELECT o_orderpriority, year(o_orderdate)::INT AS year, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 0")
def topic_year_counts(spark, d):
    return read(spark, d, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))


@query("SELECT year(o_orderdate)::INT AS year, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1")
def year_distinct_counts(spark, d):
    li = read(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    per = li.groupBy("l_orderkey").agg(F.count("*").alias("k"))
    o = read(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year")).join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.groupBy("year").agg(F.countDistinct("o_orderkey").alias("orders"), F.coalesce(F.sum("k"), F.lit(0)).alias("lines"))


@query("SELECT min(ts)::DATE AS first_day, max(ts)::DATE AS last_day, count(*) AS n FROM events WHERE event_type = 'click'")
def coverage(spark, d):
    e = read(spark, d, "events").where("event_type = 'click'")
    return e.agg(F.min("ts").cast("date").alias("first_day"), F.max("ts").cast("date").alias("last_day"), F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS large, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def filtered_count(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("large"), F.round(F.avg("value"), 6).alias("mean"))


@query("(SELECT o_orderkey, 'prev' AS side FROM orders WHERE (year(o_orderdate), o_orderkey) < (1998, 500) ORDER BY year(o_orderdate) DESC, o_orderkey DESC LIMIT 1) UNION ALL (SELECT o_orderkey, 'next' FROM orders WHERE (year(o_orderdate), o_orderkey) > (1998, 500) ORDER BY year(o_orderdate), o_orderkey LIMIT 1)")
def prev_next(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    return L.adjacent(o, ["year", "o_orderkey"], [1998, 500]).select("o_orderkey", "side")


@query("SELECT (SELECT max(o_orderdate::DATE) FROM orders) AS latest, (SELECT max(o_orderdate::DATE) FROM orders WHERE o_orderdate::DATE < DATE '2000-06-01') AS before")
def latest_day(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    latest, before = L.latest_before(o, "day"), L.latest_before(o, "day", TODAY)
    return latest.withColumnRenamed("day", "latest").join(before.withColumnRenamed("day", "before"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations")
def carry_down(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("asked"))
    return L.carry_down(c, ["conv_id"], ["turn"], "asked")


@query("""WITH a AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS k FROM events WHERE ts < TIMESTAMP '2024-01-15' AND value > 60 GROUP BY 1), b AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS k FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND value > 60 GROUP BY 1)
SELECT b.user_id FROM b LEFT JOIN a USING (user_id) WHERE b.k IS DISTINCT FROM coalesce(a.k, [])""")
def set_diff_changed(spark, d):
    e = read(spark, d, "events").where("value > 60")
    kinds = lambda rows: rows.groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return M.changed(kinds(e.where("ts < '2024-01-15'")), kinds(e.where("ts >= '2024-01-15'")), "user_id", "kinds")


@query("""WITH t AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0), u AS (SELECT o_orderkey, o_totalprice * 2 AS o_totalprice, 'X' AS o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN 'NEW' END AS o_orderpriority FROM orders WHERE o_orderkey % 5 = 0)
SELECT coalesce(t.o_orderkey, u.o_orderkey) AS o_orderkey, CASE WHEN t.o_orderkey IS NULL OR u.o_orderkey IS NOT NULL THEN round(u.o_totalprice, 4) ELSE round(t.o_totalprice, 4) END AS o_totalprice,
CASE WHEN t.o_orderkey IS NULL THEN u.o_orderstatus ELSE t.o_orderstatus END AS o_orderstatus, coalesce(u.o_orderpriority, t.o_orderpriority) AS o_orderpriority, t.o_orderkey IS NULL AS inserted FROM t FULL JOIN u ON t.o_orderkey = u.o_orderkey""")
def merge_upsert(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    news = o.where("o_orderkey % 5 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit("X").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, "NEW").alias("o_orderpriority"))
    done = M.merge(o.where("o_orderkey % 3 <> 0"), news, ["o_orderkey"], {"o_totalprice": "new", "o_orderpriority": "prefer_new"})
    return done.select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"), "o_orderstatus", "o_orderpriority", F.col("__inserted").alias("inserted"))


@query(SQL["merge_upsert"].replace(", t.o_orderkey IS NULL AS inserted", ""))
def versioned_merge(spark, d):
    """The same merge into a stored table, of which only the buckets that updates fall into are written again."""
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    news = o.where("o_orderkey % 5 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit("X").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, "NEW").alias("o_orderpriority"))
    target = scratch(spark, "orders")
    V.write(o.where("o_orderkey % 3 <> 0"), target, ["o_orderkey"], 1)
    V.merge_into(target, news, o.schema, ["o_orderkey"], {"o_totalprice": "new", "o_orderpriority": "prefer_new"}, 2)
    done = V.table(spark, target, o.schema)
    return done.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 <> 0 AND c_custkey % 3 = 0")
def insert_ignore(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_name")
    return M.insert_ignore(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0"), ["c_custkey"], "c_name")


@query("""SELECT o_orderkey FROM (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'failed' ELSE 'ok' END AS status, o_custkey % 5 AS tries FROM orders)
WHERE status = 'pending' OR (status IN ('failed', 'needs_review') AND tries < 3 AND o_orderdate::DATE < DATE '2000-06-01' - 30) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 40""")
def queue_select(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderdate"), (F.col("o_custkey") % 5).alias("tries"), F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "failed").otherwise("ok").alias("status"))
    return M.work_queue(o, "status", "tries", "day", F.lit(TODAY).cast("date"), [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_orderkey")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_props(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 5000 THEN 'open' WHEN c_acctbal < 5000 THEN 'closed' END AS state FROM customer")
def deadline_state(spark, d):
    day = F.date_add(F.lit("2000-01-01").cast("date"), F.floor("c_acctbal").cast("int"))
    limit = F.date_add(F.lit("2000-01-01").cast("date"), F.lit(5000))
    return read(spark, d, "customer").select("c_custkey", L.deadline_state(day, limit).alias("state"))


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1998 AND o_orderdate::DATE >= DATE '1998-03-01' AND o_orderpriority IN ('1-URGENT', '5-LOW') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 20")
def list_page(spark, d):
    o = read(spark, d, "orders")
    day = F.col("o_orderdate").cast("date")
    rows = o.where(L.all_of([L.date_filter(day, 1998, "1998-03-01", None, year_yields=False), F.col("o_orderpriority").isin("1-URGENT", "5-LOW"), None]))
    return rows.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(20).limit(20).select("o_orderkey")


@query("SELECT count(*) AS n FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'")
def search_range_over_year(spark, d):
    o = read(spark, d, "orders")
    return o.where(L.date_filter(F.col("o_orderdate").cast("date"), 1999, "1997-01-01", "1997-06-30")).agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey FROM orders WHERE o_orderdate::DATE > DATE '{TODAY}' - INTERVAL 6 MONTH")
def recent_slugs(spark, d):
    return read(spark, d, "orders").where(L.recent(F.col("o_orderdate").cast("date"), F.lit(TODAY).cast("date"), 6)).select("o_orderkey")


@query("SELECT doc_id, coalesce(length(text), 0) < 200000 AND coalesce(length(text || text), 0) * 20 < 200000 AS whole FROM documents")
def body_size_guard(spark, d):
    """Both bodies of a record under the limit; the second one is long enough to reach it."""
    docs = read(spark, d, "documents").withColumn("markdown", F.repeat(F.concat("text", "text"), F.lit(20)))
    return docs.select("doc_id", P.body_guard(["text", "markdown"]).alias("whole"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (5, 3, 999999999, 1)")
def slugs_in_order(spark, d):
    return L.in_list_order(read(spark, d, "customer"), "c_custkey", [5, 3, 999_999_999, 1]).select("c_custkey", "c_name")


@query("SELECT c_custkey, count(o_orderkey) AS record_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def refresh_counts(spark, d):
    counts = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    return read(spark, d, "customer").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("k", F.lit(0)).cast("long").alias("record_count"))


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderdate::DATE = DATE '2000-06-01') AS today, (SELECT count(*) FROM orders) AS total, (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS latest")
def site_status(spark, d):
    o = read(spark, d, "orders")
    today = F.count_if(F.col("o_orderdate").cast("date") == F.lit(TODAY).cast("date"))
    return o.agg(today.alias("today"), F.count("*").alias("total"), F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("latest"))


@query("SELECT CASE WHEN regexp_matches(n_name, '^[A-Za-z]') THEN upper(translate(left(n_name, 1), 'iı', 'İI')) ELSE '#' END AS letter, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def letter_groups(spark, d):
    return LB.letter_groups(read(spark, d, "nation"), "n_name", ["n_name"]).select("letter", F.array_join("titles", ",").alias("names"))


@query("SELECT url, sum(length(html))::BIGINT AS clicks FROM pages GROUP BY url HAVING sum(length(html)) > 0 ORDER BY clicks DESC, url LIMIT 12")
def top_pages(spark, d):
    return read(spark, d, "pages").groupBy("url").agg(F.sum(F.length("html")).alias("clicks")).where("clicks > 0").orderBy(F.desc("clicks"), "url").limit(12)


@query("SELECT event_type, round(avg((value < 5)::INT), 9) AS rate, avg((value < 5)::INT) > 0.15 AS alarm FROM events GROUP BY 1")
def empty_result_rate(spark, d):
    e = read(spark, d, "events").groupBy("event_type").agg(F.avg((F.col("value") < 5).cast("int")).alias("r"))
    return e.select("event_type", F.round("r", 9).alias("rate"), (F.col("r") > 0.15).alias("alarm"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10")
def prompt_groups(spark, d):
    return read(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_orderstatus", "o_orderpriority").limit(10)


@query("""WITH bare AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) SELECT DISTINCT b.doc_id, l.toxic AS label FROM bare b JOIN labels l ON l.doc_id = b.doc_id + 1""")
def inherit_labels(spark, d):
    docs = read(spark, d, "documents").select("doc_id")
    labels = read(spark, d, "labels").select("doc_id", F.col("toxic").alias("label"))
    return M.inherit_labels(docs, labels, docs.select("doc_id", (F.col("doc_id") + 1).alias("cited_id")), "doc_id", "label")


@query("""WITH a AS (SELECT c_custkey AS alert_id, 'k' || c_custkey AS topic, 'F-' || (c_custkey + 1) AS doc_type, c_custkey + 2 AS entity, c_custkey % 6 AS kind, ' clerk' || c_custkey || ' ' AS own, ' clerk' || (c_custkey + 3) || ' ' AS other FROM customer WHERE c_acctbal > 0),
e AS (SELECT o_orderkey AS id, 'k' || o_custkey AS topic, o_orderstatus || '-' || o_custkey AS doc_type, o_custkey AS entity, ' ' || trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g')) || ' order clerk' || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN ' late' ELSE '' END || CASE WHEN o_orderkey % 997 > 0 THEN ' tender' ELSE '' END || ' ' AS t FROM orders),
q AS (SELECT alert_id, id FROM a JOIN e ON CASE kind WHEN 0 THEN contains(t, own) AND contains(t, ' urgent ') WHEN 1 THEN contains(t, ' order' || own) WHEN 2 THEN contains(t, own) AND NOT contains(t, ' urgent ') AND NOT contains(t, ' late ')
  WHEN 3 THEN contains(t, own) OR contains(t, other) OR (contains(t, ' 4 ') AND contains(t, ' not specified ') AND NOT contains(t, ' tender ')) WHEN 4 THEN contains(t, ' tender ') AND contains(t, own) AND NOT contains(t, ' 3 medium ') ELSE alert_id % 600 = 5 AND NOT contains(t, ' tender ') END)
SELECT alert_id, id FROM a JOIN e USING (topic) UNION SELECT alert_id, id FROM a JOIN e USING (doc_type) UNION SELECT alert_id, id FROM a JOIN e USING (entity) UNION SELECT alert_id, id FROM q""")
def alert_match(spark, d):
    key, order = F.col("c_custkey"), F.col("o_orderkey")
    own = lambda n: F.concat(F.lit("clerk"), key + n)
    asked = [F.concat(own(0), F.lit(" urgent")), F.concat(F.lit('"Order '), own(0), F.lit('"')), F.concat(own(0), F.lit(" -urgent -late")), F.concat(own(0), F.lit(" OR "), own(3), F.lit(' OR 4 "not specified" -tender')),
             F.concat(F.lit("tender "), own(0), F.lit(' -"3 medium"')), F.when(key % 600 == 5, "-tender")]
    alerts = read(spark, d, "customer").select(
        key.alias("alert_id"), (F.col("c_acctbal") > 0).alias("is_active"), F.array(F.concat(F.lit("k"), key)).alias("topics"),
        F.array(F.concat(F.lit("F-"), key + 1)).alias("doc_types"), F.array(key + 2).alias("entity_ids"), F.get(F.array(*asked), (key % 6).cast("int")).alias("query"))
    text = F.concat("o_orderpriority", F.lit(" order clerk"), "o_custkey", F.when(order % 3 == 0, " late").otherwise(""), F.when(order % 997 > 0, " tender").otherwise(""))
    records = read(spark, d, "orders").select(
        order.alias("id"), F.array(F.concat(F.lit("k"), "o_custkey")).alias("topics"), F.concat_ws("-", "o_orderstatus", "o_custkey").alias("doc_type"), F.array("o_custkey").alias("entity_ids"), text.alias("text"))
    return K.alert_matches(alerts, records)

"""Queries of classification and parsing over titles and pages made to reach every rule.

The order tables hold no gazette text, so titles, pages and bodies are put together from
the keys; SQL puts together the same ones, and says from the rule tables what they are.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulary.functions import classify as K
from tabulary.functions import gazette as G
from tabulary.operators import linking
from tabulary.sources.tables import read

QUERIES: dict = {}
SQL: dict[str, str] = {}

_WORDS = tuple(dict.fromkeys([w for *_, words in K.DOC_TYPE_RULES for w in words] + [w for _, words, _ in K.TOPIC_KEYWORDS for w in words] + ["YASAKLI GÖÇMEN", "GENELGE Ö.", "ÖĞRETMEN", "YÜKSELME", "KAMU HİZMETİ KOMİSYONU", "PLAJ"]))
_REFS = (None, *dict.fromkeys(r for _, refs, *_ in K.DOC_TYPE_RULES for r in refs), "ae")
_SECTIONS = ("MAIN", *dict.fromkeys(s for _, _, sections, _ in K.DOC_TYPE_RULES for s in sections))


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


#: Two keywords each, every third in small letters; reference types and sections in turn.
_MADE = f"""made AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN lower(translate(t, 'İI', 'iı')) ELSE t END AS title, {_list(_REFS)}[o_orderkey % {3 * len(_REFS)} + 1] AS ref_type, {_list(_SECTIONS)}[o_custkey % {4 * len(_SECTIONS)} + 1] AS section,
  CASE o_orderkey % 7 WHEN 0 THEN repeat('x ', 150) WHEN 1 THEN 'Kamu Hizmeti Komisyonu' WHEN 2 THEN repeat('y', 1700) || ' mia. 12 / 2025' WHEN 3 THEN 'kısa' WHEN 4 THEN repeat('z', 1801) || ' MT 1/2025' END AS body
  FROM (SELECT *, 'BİR ' || {_list(_WORDS)}[o_orderkey % {len(_WORDS)} + 1] || ' ile ' || {_list((*_WORDS[::5], 'YOL'))}[o_custkey % {len(_WORDS[::5]) + 1} + 1] AS t FROM orders)),
typed AS (SELECT *, upper(translate(title, 'iı', 'İI')) AS u FROM made)"""


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(u, '{w}')" for w in words) + ")"


def _type_sql() -> str:
    out = []
    for name, refs, sections, words in K.DOC_TYPE_RULES:
        tests = [f"coalesce({c} IN ({', '.join(repr(v) for v in values)}), false)" for c, values in (("ref_type", refs), ("section", sections)) if values] + ([_any(words)] if words else [])
        out.append(f"WHEN {' AND '.join(tests)} THEN '{name}'")
    return f"CASE {' '.join(out)} ELSE 'diger' END"


_TYPED = f"""{_MADE}, kinds AS (SELECT *, {_type_sql()} AS kind FROM typed)"""
_BY_TYPE = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.TOPIC_BY_DOC_TYPE.items()) + " END"
_BY_WORD = ", ".join(f"CASE WHEN {_any(words)}{' AND kind NOT IN (' + ', '.join(map(repr, out)) + ')' if out else ''} THEN '{topic}' END" for topic, words, out in K.TOPIC_KEYWORDS)
_CIRCULAR = r"(^|[^A-Za-z0-9_])(m[iıİI]a|mt|ö|y)\.?\s*[0-9]+\s*/\s*[0-9]{4}($|[^A-Za-z0-9_])"
_ISSUER = f"""by_whom AS (SELECT *, CASE WHEN contains(u, 'KAMU HİZMETİ KOMİSYON') OR contains(upper(translate(left(coalesce(body, ''), 1800), 'iı', 'İI')), 'KAMU HİZMETİ KOMİSYON') OR regexp_matches(title, '{_CIRCULAR}', 'i') OR regexp_matches(left(coalesce(body, ''), 1800), '{_CIRCULAR}', 'i') OR kind = 'genelge' THEN 'khk'
  WHEN length(trim(coalesce(body, ''))) >= 200 THEN 'diger' END AS issuer FROM kinds)"""


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def _titles(spark, d):
    o = read(spark, d, "orders")
    pick = lambda values, key, n: F.get(F.array(*(F.lit(v).cast("string") for v in values)), (key % n).cast("int"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    title = F.concat(F.lit("BİR "), pick(_WORDS, key, len(_WORDS)), F.lit(" ile "), pick((*_WORDS[::5], "YOL"), cust, len(_WORDS[::5]) + 1))
    body = (F.when(key % 7 == 0, F.repeat(F.lit("x "), 150)).when(key % 7 == 1, "Kamu Hizmeti Komisyonu").when(key % 7 == 2, F.concat(F.repeat(F.lit("y"), 1700), F.lit(" mia. 12 / 2025")))
            .when(key % 7 == 3, "kısa").when(key % 7 == 4, F.concat(F.repeat(F.lit("z"), 1801), F.lit(" MT 1/2025"))))
    rows = o.select(key.alias("id"), F.when(key % 3 == 0, F.lower(F.translate(title, "İI", "iı"))).otherwise(title).alias("title"), pick(_REFS, key, 3 * len(_REFS)).alias("ref_type"), pick(_SECTIONS, cust, 4 * len(_SECTIONS)).alias("section"), body.alias("body"))
    return rows.withColumn("kind", K.doc_type(F.col("title"), F.col("section"), F.col("ref_type")))


@query(f"WITH {_TYPED} SELECT id, kind FROM kinds")
def title_types(spark, d):
    return _titles(spark, d).select("id", "kind")


@query(f"WITH {_TYPED}, w AS (SELECT id, list_filter([{_BY_TYPE}, {_BY_WORD}], lambda x: x IS NOT NULL) AS t FROM kinds) SELECT id, array_to_string(list_sort(list_distinct(t)), ',') AS topics FROM w")
def title_topics(spark, d):
    return _titles(spark, d).select("id", F.array_join(F.array_sort(K.topics(F.col("title"), F.col("kind"))), ",").alias("topics"))


@query(f"WITH {_TYPED}, {_ISSUER} SELECT id, issuer FROM by_whom")
def title_issuers(spark, d):
    return _titles(spark, d).select("id", K.issuer(F.col("title"), F.col("kind"), F.col("body")).alias("issuer"))


@query(f"""WITH {_TYPED}, {_ISSUER} SELECT id, CASE WHEN issuer = 'khk' THEN CASE ref_type WHEN 'mia' THEN 'ilk_atama' WHEN 'khkmt' THEN 'yukselme' WHEN 'khko' THEN 'ogretmen' ELSE
CASE WHEN contains(u, 'ÖĞRETMEN') OR contains(u, 'ÖĞRETİM DAİRESİ') OR regexp_matches(u, 'GENELGE\\s+Ö\\.') THEN 'ogretmen' WHEN contains(u, 'YÜKSELME') OR contains(u, 'TERFİ') THEN 'yukselme' WHEN contains(u, 'İLK ATAMA') OR contains(u, 'İLK ATANMA') THEN 'ilk_atama' END END END AS vacancy,
kind = 'sinav_sonucu' OR contains(u, 'YASAKLI GÖÇMEN') OR contains(u, 'SINAV SONUÇLARI') AS personal FROM by_whom""")
def title_vacancies(spark, d):
    rows = _titles(spark, d).withColumn("issuer", K.issuer(F.col("title"), F.col("kind"), F.col("body")))
    return rows.select("id", K.munhal_kind(F.col("title"), F.col("ref_type"), F.col("issuer")).alias("vacancy"), K.personal_data(F.col("title"), F.col("kind")).alias("personal"))


@query("""SELECT c_custkey, 0::INT AS ordinal, 'EK_III' AS section, 'ae' AS ref_type, c_custkey::VARCHAR AS ref_number, 'REKABET KURULU ' || c_name || ' KONU: ' || c_mktsegment AS title, c_mktsegment AS subject, false AS is_correction FROM customer
UNION ALL SELECT c_custkey, 1, 'EK_III', 'ae', (c_custkey + 1)::VARCHAR, 'A.E. ' || (c_custkey + 1), NULL, false FROM customer UNION ALL SELECT c_custkey, 2, 'EK_VI', NULL, NULL, 'DÜZELTME: ' || c_mktsegment || ' hakkında', NULL, true FROM customer""")
def contents_tables(spark, d):
    c, key = read(spark, d, "customer"), F.col("c_custkey").cast("string")
    html = F.concat(F.lit("<table><tr><td>EK  III</td><td>A.E. "), key, F.lit("</td><td>REKABET KURULU "), "c_name", F.lit(" KONU: "), "c_mktsegment", F.lit("</td><td>x</td></tr><tr><td>&nbsp;</td><td>A.E. "), (F.col("c_custkey") + 1).cast("string"),
                    F.lit("</td><td></td></tr><tr><td>EK VI</td><td></td><td>DÜZELTME: "), "c_mktsegment", F.lit(" hakkında</td></tr><tr><td> </td></tr></table>"))
    return G.parse_contents_table(c.select("c_custkey", html.alias("html")), ["c_custkey"], "html")


@query("""SELECT c_custkey, 0::INT AS ordinal, 'EK_V_B_I' AS section, 'sm' AS ref_type, c_custkey::VARCHAR AS ref_number, 'Ş.M. ' || c_custkey || ' BİR LTD' AS title, NULL AS subject, false AS is_correction FROM customer
UNION ALL SELECT c_custkey, 1, 'EK_V_B_I', 'sm', (c_custkey + 7)::VARCHAR, 'Ş.M. ' || (c_custkey + 7) || ' İKİ LTD', NULL, false FROM customer UNION ALL SELECT c_custkey, 2, 'MAIN', NULL, NULL, 'Referanssız ' || c_mktsegment, NULL, false FROM customer""")
def contents_texts(spark, d):
    c, key = read(spark, d, "customer"), F.col("c_custkey").cast("string")
    text = F.concat(F.lit("EK V BÖLÜM I:\nŞ.M. "), key, F.lit(" BİR LTD Ş.M. "), (F.col("c_custkey") + 7).cast("string"), F.lit(" İKİ LTD\nMAIN\nReferanssız "), "c_mktsegment", F.lit("\nkısa"))
    return G.parse_contents_text(c.select("c_custkey", text.alias("text")), ["c_custkey"], "text")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN o_orderdate::DATE + 9 END AS deadline_at, CASE WHEN o_orderkey % 4 = 1 THEN 'üç kadro' END AS note FROM orders""")
def made_deadlines(spark, d):
    day = F.col("o_orderdate").cast("date")
    months = F.array(*map(F.lit, ("Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık")))
    long = lambda x: F.concat_ws(" ", F.dayofmonth(x).cast("string"), F.get(months, F.month(x) - 1), F.year(x).cast("string"))
    n = F.col("o_orderkey") % 4
    body = (F.when(n == 0, F.concat(F.lit("Son başvuru "), F.date_format(day, "dd.MM.yyyy"), F.lit(" günüdür.")))
            .when(n == 1, F.concat(F.lit("Üç kadro için başvurular "), long(day), F.lit(" - "), long(F.date_add(day, 9)), F.lit(" arasında yapılır.")))
            .when(n == 2, F.concat(F.lit("Son başvuru "), F.date_format(day, "dd.MM.yyyy"), F.lit(" ya da "), F.date_format(F.date_add(day, 1), "dd.MM.yyyy"))))
    made = read(spark, d, "orders").select("o_orderkey", G.extract_deadline(body).alias("x"))
    return made.select("o_orderkey", F.col("x.deadline_at").alias("deadline_at"), F.col("x.note").alias("note"))


@query("""SELECT c_custkey, 'company' AS kind, 'firma-' || c_custkey || '-gida-ltd' AS slug, 1.0::DOUBLE AS confidence FROM customer UNION ALL SELECT c_custkey, 'place', 'lefke', 1.0 FROM customer
UNION ALL SELECT c_custkey, 'place', 'girne', 0.7 FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'institution', 'bakanlar-kurulu', 0.7 FROM customer WHERE c_custkey % 3 = 0""")
def made_entities(spark, d):
    title = F.concat(F.lit("FİRMA "), F.col("c_custkey").cast("string"), F.lit(" GIDA LTD lefke yolu"))
    body = F.concat(F.when(F.col("c_custkey") % 2 == 0, "Girne için ").otherwise(""), F.when(F.col("c_custkey") % 3 == 0, "Bakanlar Kurulu kararı").otherwise("karar"))
    found = read(spark, d, "customer").select("c_custkey", F.explode(G.entities(title, body)).alias("e"))
    return found.select("c_custkey", "e.kind", "e.slug", F.col("e.confidence").cast("double").alias("confidence"))


@query("""WITH k AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'mia' WHEN c_custkey % 3 = 1 THEN 'khkmt' END AS ref_type, (c_custkey % 70) || '/2025' AS ref_number, CASE WHEN c_custkey % 9 = 0 THEN 'u' || c_custkey END AS url, 'mia. ' || (c_custkey % 90) || ' / 2025 ve' AS head FROM customer),
c AS (SELECT DISTINCT 'u' || s_suppkey AS url, 'mia' AS ref_type, s_suppkey || '/2025' AS ref_number, s_suppkey FROM supplier), m AS (SELECT c.url, count(k.id) AS n, min(k.id) AS one FROM c LEFT JOIN k ON (k.ref_type = c.ref_type AND k.ref_number = c.ref_number) OR k.id % 90 = s_suppkey GROUP BY 1)
SELECT m.url, CASE WHEN o.id IS NOT NULL THEN 'imported' WHEN n = 1 THEN 'have' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status, CASE WHEN o.id IS NOT NULL THEN o.id WHEN n = 1 THEN one END AS record_id FROM m LEFT JOIN (SELECT url, min(id) AS id FROM k WHERE url IS NOT NULL GROUP BY 1) o ON o.url = m.url""")
def circular_matches(spark, d):
    key = F.col("c_custkey")
    records = read(spark, d, "customer").select(key.alias("id"), F.when(key % 3 == 0, "mia").when(key % 3 == 1, "khkmt").alias("ref_type"), F.concat((key % 70).cast("string"), F.lit("/2025")).alias("ref_number"),
                                                F.when(key % 9 == 0, F.concat(F.lit("u"), key)).alias("source_url"), F.concat(F.lit("mia. "), (key % 90).cast("string"), F.lit(" / 2025 ve")).alias("head"))
    s = F.col("s_suppkey").cast("string")
    circulars = read(spark, d, "supplier").select(F.concat(F.lit("u"), s).alias("url"), F.lit("mia").alias("ref_type"), F.concat(s, F.lit("/2025")).alias("ref_number"))
    return linking.circular_matches(circulars, records)


@query(r"""WITH k AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'mia' WHEN c_custkey % 3 = 1 THEN 'khkmt' END AS ref_type, (c_custkey % 70) || '/2025' AS ref_number, CASE WHEN c_custkey % 9 = 0 THEN 'https://f/' || c_custkey || '.pdf' END AS url, 'mia. ' || (c_custkey % 90) || ' / 2025 ve' AS head FROM customer),
r AS (SELECT o_orderkey AS row, o_orderkey % 900 AS n, ['mia', 'khkmt', NULL, NULL][o_orderkey % 4 + 1] AS ref_type, ['MİA', 'MT', 'YD', ''][o_orderkey % 4 + 1] AS series, o_custkey % 5 < 3 AS vacancy, CASE WHEN o_custkey % 13 > 0 THEN 'Tapu ' || (o_custkey % 7) END AS department, o_orderkey % 11 = 0 AS cancelled, 'https://f/' || (o_custkey % 800) || '.pdf' AS url, o_orderkey % 17 > 0 AS filed FROM orders),
c AS (SELECT DISTINCT ON (series, n) row, series || '.' || n || '/2025' AS label, ref_type, n || '/2025' AS ref_number, n, department, cancelled, url FROM r WHERE ref_type IS NOT NULL AND vacancy AND filed AND department IS NOT NULL ORDER BY series, n, row),
m AS (SELECT c.label, count(k.id) AS found, min(k.id) AS one FROM c LEFT JOIN k ON (k.ref_type = c.ref_type AND k.ref_number = c.ref_number) OR (c.ref_type = 'mia' AND k.id % 90 = n) GROUP BY 1),
o AS (SELECT url, min(id) AS id FROM k WHERE url IS NOT NULL GROUP BY 1)
SELECT c.label, c.url, department, cancelled, CASE WHEN o.id IS NOT NULL THEN 'imported' WHEN found = 1 THEN 'have' WHEN found > 1 THEN 'ambiguous' ELSE 'missing' END AS status, CASE WHEN o.id IS NOT NULL THEN o.id WHEN found = 1 THEN one END AS record_id FROM c JOIN m USING (label) LEFT JOIN o ON o.url = c.url""")
def circular_listing(spark, d):
    """Listings made of the orders: repeats, cancellations, other categories, rows without file or department."""
    key, row, cust = F.col("c_custkey"), F.col("o_orderkey"), F.col("o_custkey")
    records = read(spark, d, "customer").select(key.alias("id"), F.when(key % 3 == 0, "mia").when(key % 3 == 1, "khkmt").alias("ref_type"), F.concat((key % 70).cast("string"), F.lit("/2025")).alias("ref_number"),
                                                F.when(key % 9 == 0, F.concat(F.lit("https://f/"), key, F.lit(".pdf"))).alias("source_url"), F.concat(F.lit("mia. "), (key % 90).cast("string"), F.lit(" / 2025 ve")).alias("head"))
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    rows = read(spark, d, "orders").select(
        row.alias("row"), F.concat(pick(("MİA. ", "mt.", "YD ", "Duyuru "), row % 4), row % 900, F.lit(" / 2025")).alias("circular"), pick(("2025 İlk-Atama", "Yükselme", "öğretmenlik", "Sözleşmeli", "Sınav"), cust % 5).alias("category"),
        F.when(cust % 13 > 0, F.concat(F.lit("Tapu "), cust % 7, F.when(row % 11 == 0, " ( İptal )").otherwise(""))).otherwise("").alias("department"),
        F.when(row % 17 > 0, F.concat(F.lit("https://f/"), cust % 800, F.lit(".pdf?ver="), row)).alias("pdf_url"), F.lit("1.2.2025").alias("deadline_text"))
    found = linking.circular_candidates(rows)
    status = linking.circular_matches(found.select("url", "label", "ref_type", "ref_number"), records, ["label"])
    return found.join(status, ["label", "url"]).select("label", "url", "department", "cancelled", "status", "record_id")


@query(r"""WITH p AS (SELECT o_custkey AS issue, o_orderkey AS number, CASE o_orderkey % 3 WHEN 0 THEN 'Sayı : ' WHEN 1 THEN 'SAYI:' ELSE 'sayı  :  ' END || o_orderkey || chr(10) || repeat('metin' || (o_orderkey % 7) || ' ', (o_orderkey % 12)::INT) || chr(10) || CASE WHEN o_orderkey % 4 = 0 THEN chr(12) ELSE '' END AS piece FROM orders)
SELECT issue, number::VARCHAR AS ref_number, CASE WHEN length(regexp_replace(piece, '\s+$', '')) > 40 THEN regexp_replace(piece, '\s+$', '') END AS body,
  (1 + coalesce(sum((number % 4 = 0)::INT) OVER (PARTITION BY issue ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS page_from FROM p""")
def issue_bodies(spark, d):
    """Every order's body, cut out of a text of all orders of its customer."""
    key = F.col("o_orderkey")
    head = F.when(key % 3 == 0, "Sayı : ").when(key % 3 == 1, "SAYI:").otherwise("sayı  :  ")
    piece = F.concat(head, key, F.lit("\n"), F.repeat(F.concat(F.lit("metin"), key % 7, F.lit(" ")), (key % 12).cast("int")), F.lit("\n"), F.when(key % 4 == 0, "\f").otherwise(""))
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("issue"), key, piece.alias("piece"))
    issues = rows.groupBy("issue").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "piece"))), lambda x: x["piece"]), "").alias("text"))
    records = rows.select("issue", F.lit("ae").alias("ref_type"), key.cast("string").alias("ref_number"))
    return G.extract_bodies(records, issues, "issue", "text").select("issue", "ref_number", "body", "page_from")

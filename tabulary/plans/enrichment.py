"""Classification, extraction and calculator queries, each with its SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulary.functions import calculators as C
from tabulary.functions import classify as K
from tabulary.functions import gazette as G
from tabulary.functions import text as T
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


_DURATION = "CASE WHEN e < s THEN 0 ELSE greatest(0, (year(e) - year(s)) * 12 + month(e) - month(s) - CASE WHEN day(e) < day(s) THEN 1 ELSE 0 END) END"
_SPAN = f"WITH r AS (SELECT o_orderkey, o_totalprice AS w, o_orderdate::DATE AS s, DATE '2001-08-01' AS e FROM orders), d AS (SELECT *, ({_DURATION})::INT AS m FROM r)"


def _span(spark, d):
    o = read(spark, d, "orders")
    return o.select("o_orderkey", F.col("o_totalprice").alias("w"), F.col("o_orderdate").cast("date").alias("s"), F.lit("2001-08-01").cast("date").alias("e"))


@query(f"{_SPAN} SELECT o_orderkey, (m // 12)::INT AS years, (m % 12)::INT AS months, CASE WHEN e < s THEN 0 ELSE datediff('day', (s + to_months(m))::DATE, e) END::INT AS days, m AS total_months FROM d")
def service_duration(spark, d):
    r = _span(spark, d).withColumn("d", C.service_duration(F.col("s"), F.col("e")))
    return r.select("o_orderkey", "d.years", "d.months", "d.days", "d.total_months")


@query(f"""{_SPAN} SELECT o_orderkey, round(w * 12 / 52 * CASE WHEN m <= 2 THEN 0 WHEN m <= 5 THEN 1 WHEN m <= 11 THEN 2 WHEN m <= 23 THEN 3 WHEN m <= 60 THEN 4 ELSE 5 END, 4) AS severance,
round(w * 12 / 52 * CASE WHEN m <= 6 THEN 1 WHEN m <= 11 THEN 3 WHEN m <= 23 THEN 4 WHEN m <= 60 THEN 5 ELSE 6 END, 4) AS notice FROM d""")
def severance(spark, d):
    none = F.lit(None).cast("int")
    r = _span(spark, d).withColumn("c", C.severance(F.col("s"), F.col("e"), F.col("w"), F.lit(False), none, none))
    return r.select("o_orderkey", F.round("c.severance", 4).alias("severance"), F.round("c.notice", 4).alias("notice"))


@query(f"""{_SPAN}, t AS (SELECT *, CASE WHEN m <= 60 THEN 14 WHEN m <= 119 THEN 18 WHEN m <= 179 THEN 22 ELSE 25 END AS f, CASE WHEN (m // 12) * 12 <= 60 THEN 14 WHEN (m // 12) * 12 <= 119 THEN 18 WHEN (m // 12) * 12 <= 179 THEN 22 ELSE 25 END AS c FROM d)
SELECT o_orderkey, CASE WHEN m < 6 THEN 'under-six-months' END AS reason, round(CASE WHEN m < 6 THEN 0 WHEN m >= 12 THEN c::DOUBLE ELSE f * (m % 12)::DOUBLE / 12 END, 6) AS usable FROM t""")
def annual_leave(spark, d):
    none = F.lit(None).cast("date")
    r = _span(spark, d).withColumn("c", C.annual_leave(F.col("s"), F.col("e"), none, F.lit(False), F.lit(0)))
    return r.select("o_orderkey", F.col("c.reason").alias("reason"), F.round("c.usable_days", 6).alias("usable"))


@query("SELECT c_custkey, round(greatest(c_acctbal, 0) / 176, 6) AS hourly, round(greatest(c_acctbal, 0) / 176 * (1.1::DOUBLE * (c_custkey % 9) + 1.5::DOUBLE * (c_custkey % 4)), 2) AS total FROM customer")
def overtime(spark, d):
    c = read(spark, d, "customer")
    zero = F.lit(0)
    made = C.overtime(F.col("c_acctbal"), F.lit(176.0), F.col("c_custkey") % 9, F.col("c_custkey") % 4, zero, zero, zero)
    return c.withColumn("c", made).select("c_custkey", F.round("c.hourly", 6).alias("hourly"), F.round("c.total", 2).alias("total"))


@query("""WITH r AS (SELECT c_custkey, greatest(c_acctbal * 60, 0) AS g FROM customer), b AS (SELECT *, CASE WHEN g > 70893.0 * 7 THEN 70893.0 * 7 WHEN g > 0 AND g < 70893 THEN 70893.0 ELSE g END::DOUBLE AS base FROM r)
SELECT c_custkey, round(base, 4) AS base, round(g - base * 0.09::DOUBLE - g * 0.04::DOUBLE, 4) AS net, round(g + base * 0.11::DOUBLE + g * 0.04::DOUBLE, 4) AS cost FROM b""")
def payroll(spark, d):
    c = read(spark, d, "customer").withColumn("p", C.payroll(F.col("c_acctbal") * 60, F.lit("sgk"), F.lit(False), F.lit(0.5)))
    return c.select("c_custkey", F.round("p.base", 4).alias("base"), F.round("p.net_before_tax", 4).alias("net"), F.round("p.employer_cost", 4).alias("cost"))


@query("""WITH r AS (SELECT c_custkey, greatest(c_acctbal * 10, 0) AS x FROM customer) SELECT c_custkey, round((least(x, 3750) * 10 + least(greatest(x - 3750, 0), 3750) * 20 + least(greatest(x - 7500, 0), 10000) * 25
+ least(greatest(x - 17500, 0), 190000::DOUBLE / 12) * 30 + greatest(x - 17500 - 190000::DOUBLE / 12, 0) * 37) / 100, 4) AS tax FROM r""")
def progressive_tax(spark, d):
    c = read(spark, d, "customer").withColumn("t", C.progressive_tax(F.col("c_acctbal") * 10, F.lit(12)))
    return c.select("c_custkey", F.round("t.tax", 4).alias("tax"))


@query("""WITH r AS (SELECT c_custkey, greatest(c_acctbal * 40, 0) AS g, c_custkey % 5 AS k, c_custkey % 2 = 0 AS sp FROM customer),
a AS (SELECT *, greatest(g - g * 0.1::DOUBLE - least(g * 0.09::DOUBLE, g * 0.13::DOUBLE) - (655000 + CASE WHEN sp THEN 52400 ELSE 0 END + k * 39300)::DOUBLE / 13, 0) AS x FROM r),
t AS (SELECT *, (least(x, 45000::DOUBLE / 13) * 10 + least(greatest(x - 45000::DOUBLE / 13, 0), 45000::DOUBLE / 13) * 20 + least(greatest(x - 90000::DOUBLE / 13, 0), 120000::DOUBLE / 13) * 25
+ least(greatest(x - 210000::DOUBLE / 13, 0), 190000::DOUBLE / 13) * 30 + greatest(x - 400000::DOUBLE / 13, 0) * 37) / 100 AS tax FROM a)
SELECT c_custkey, round(x, 4) AS taxable, round(tax - tax * CASE WHEN k >= 3 THEN 15 + 5 * (k - 3) ELSE 0 END / 100, 4) AS tax FROM t""")
def income_tax(spark, d):
    g, k = F.greatest(F.col("c_acctbal") * 40, F.lit(0.0)), F.col("c_custkey") % 5
    made = C.income_tax(g, g * 0.09, F.lit(13), F.col("c_custkey") % 2 == 0, {"child_a": k, "child_b": F.lit(0), "child_c": F.lit(0)}, F.lit("none"), F.lit(False))
    return read(spark, d, "customer").withColumn("t", made).select("c_custkey", F.round("t.taxable_base", 4).alias("taxable"), F.round("t.tax", 4).alias("tax"))


@query(f"{_SPAN} SELECT o_orderkey, round(w * 0.08::DOUBLE * m, 3) AS contributions, round(coalesce(w * 0.08::DOUBLE * list_sum(list_transform(range(0, m), lambda i: pow(pow(1.2::DOUBLE, 1::DOUBLE / 12), i))), 0), 2) AS balance FROM d")
def provident_fold(spark, d):
    r = _span(spark, d).withColumn("p", C.provident_fund(F.col("s"), F.col("e"), F.col("w"), F.lit("current"), F.lit(0), F.lit(0.2)))
    return r.select("o_orderkey", F.round("p.contributions", 3).alias("contributions"), F.round("p.balance", 2).alias("balance"))


@query("SELECT o_orderkey, (o_orderdate::DATE - 42) AS mandatory_start, (o_orderdate::DATE + 41) AS mandatory_end, ((o_orderdate::DATE + INTERVAL 9 MONTH)::DATE - 1) AS nursing_end FROM orders")
def maternity(spark, d):
    o = read(spark, d, "orders").withColumn("m", C.maternity(F.col("o_orderdate").cast("date")))
    return o.select("o_orderkey", "m.mandatory_start", "m.mandatory_end", "m.nursing_end")


@query("SELECT c_custkey, (CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END * (CASE WHEN c_nationkey % 2 = 0 THEN 2 ELSE 1 END) * 70893.0 * greatest(1, c_custkey % 7))::DOUBLE AS fine FROM customer")
def work_permit_penalty(spark, d):
    made = C.work_permit_penalty(F.lit("unlicensed-employment"), F.col("c_custkey") % 7, F.col("c_custkey") % 3 + 1, F.col("c_nationkey") % 2 == 0)
    return read(spark, d, "customer").withColumn("p", made).select("c_custkey", F.col("p.fine").alias("fine"))


@query("""SELECT doc_id, CASE WHEN contains(u, 'MARKA TESCİL MÜRACAATI') THEN 'marka_ilani' WHEN contains(u, 'ATAMA') THEN 'atama_kararnamesi' WHEN contains(u, 'DAVA') THEN 'mahkeme_duyurusu' WHEN contains(u, 'MAHKEME') THEN 'mahkeme_duyurusu'
WHEN source = 'src1' THEN 'bakanlar_kurulu_karari' ELSE 'diger' END AS doc_type FROM (SELECT *, upper(translate(text, 'iı', 'İI')) AS u FROM documents)""")
def doc_types(spark, d):
    docs = read(spark, d, "documents")
    section = F.when(F.col("source") == "src1", "EK_IV_B_I").otherwise("MAIN")
    return docs.select("doc_id", K.doc_type(F.col("text"), section, F.lit(None).cast("string")).alias("doc_type"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(u, 'İMAR') OR contains(u, 'PARSEL') OR contains(u, 'ARAZİ') THEN 'gayrimenkul' END, CASE WHEN contains(u, 'MARKA') THEN 'marka' END,
CASE WHEN contains(u, 'PRİM') OR contains(u, 'HARÇ') OR contains(u, 'KATKI') THEN 'vergi-mali' END], lambda x: x IS NOT NULL), ',') AS topics FROM (SELECT *, upper(translate(text, 'iı', 'İI')) AS u FROM documents)""")
def topics(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(K.topics(F.col("text"), F.lit("diger")), ",").alias("topics"))


@query("""SELECT doc_id, CASE WHEN length(trim(text)) >= 200 THEN 'diger' END AS issuer FROM documents""")
def issuers(spark, d):
    return read(spark, d, "documents").select("doc_id", K.issuer(F.lit("x"), F.lit("diger"), F.col("text")).alias("issuer"))


@query("SELECT c_custkey, c_custkey || '''' || CASE WHEN c_custkey % 10 IN (3, 4, 5) OR (c_custkey % 10 = 0 AND (c_custkey // 10) % 10 IN (4, 6, 7)) THEN 't' ELSE 'd' END || CASE WHEN (CASE WHEN c_custkey % 10 > 0 THEN c_custkey % 10 IN (6, 9) WHEN (c_custkey // 10) % 10 > 0 THEN (c_custkey // 10) % 10 IN (1, 3, 4, 6, 9) ELSE false END) THEN 'an' ELSE 'en' END AS since FROM customer")
def year_suffix(spark, d):
    return read(spark, d, "customer").select("c_custkey", T.ablative_year(F.col("c_custkey")).alias("since"))


@query("SELECT o_orderkey, day(o_orderdate) || ' ' || ['Ocak', 'Şubat', 'Mart', 'Nisan', 'Mayıs', 'Haziran', 'Temmuz', 'Ağustos', 'Eylül', 'Ekim', 'Kasım', 'Aralık'][month(o_orderdate)] || ' ' || year(o_orderdate) AS day FROM orders")
def long_dates(spark, d):
    return read(spark, d, "orders").select("o_orderkey", T.date_long(F.col("o_orderdate").cast("date")).alias("day"))


@query(None)
def text_records(spark, d):
    """Records of every document's lines."""
    return G.parse_contents_text(read(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text")


@query(None)
def deadlines(spark, d):
    docs = read(spark, d, "documents").withColumn("d", G.extract_deadline("text"))
    return docs.select("doc_id", F.col("d.deadline_at").alias("deadline_at"), F.col("d.note").alias("note"))

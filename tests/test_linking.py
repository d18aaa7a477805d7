import datetime
import random

from pyspark.sql import functions as F

from tabulary.functions import params
from tabulary.operators import linking as L
from tabulary.operators import search as S

day = datetime.date


def test_links_between_records(spark):
    rows = [
        (1, 10, "ae", "5", "BİR KARAR", day(2025, 1, 1), None, None), (2, 10, "uki", "7-2025", "Bir  Karar", day(2025, 1, 1), None, None), (3, 10, "ukii", "8", "BİR KARAR", day(2025, 1, 1), None, None),
        (4, 11, "uki", "7-2025", "DÜZELTME: KARAR", day(2025, 2, 1), None, None), (5, 12, "ae", "9", "Ü(K-I) 7-2025 SAYILI KARARIN TADİL EDİLMESİ", day(2025, 3, 1), None, None),
    ]
    records = spark.createDataFrame(rows, "id int, issue_id int, ref_type string, ref_number string, title string, published_at date, related_record_id int, corrects_id int")
    assert [tuple(r) for r in L.related_records(records).collect()] == [(1, 2)]
    assert [tuple(r) for r in L.corrected_records(records).collect()] == [(4, 2)]
    assert sorted(tuple(r) for r in L.cited_records(records).collect()) == [(5, 2), (5, 4)]
    issues = spark.createDataFrame([(10, day(2026, 1, 1))], "id int, published_at date")
    assert {(r.id, r.published_at) for r in L.with_issue_dates(records, issues).where("id in (1, 5)").collect()} == {(1, day(2026, 1, 1)), (5, day(2025, 3, 1))}
    removed = spark.createDataFrame([(2025, 3, "ae", "5")], "year int, number int, ref_type string, ref_number string")
    assert L.without_takedowns(records.withColumns({"year": F.lit(2025), "number": F.lit(3)}), removed).count() == 4


def test_circulars(spark):
    records = spark.createDataFrame([(1, "u1", "mia", "1/2025"), (2, None, "mia", "2/2025"), (3, None, "mia", "3/2025"), (4, None, "mia", "3/2025")], "id int, source_url string, ref_type string, ref_number string")
    circulars = spark.createDataFrame([("u1", "x", "x"), ("u2", "mia", "2/2025"), ("u3", "mia", "3/2025"), ("u4", "mia", "4/2025")], "url string, ref_type string, ref_number string")
    got = {r.url: (r.status, r.record_id) for r in L.circular_matches(circulars, records).collect()}
    assert got == {"u1": ("imported", 1), "u2": ("have", 2), "u3": ("ambiguous", None), "u4": ("missing", None)}


def test_alerts(spark):
    rows = [(1, ["ihale"], [], [], True, None), (2, [], ["yasa"], [5], True, " "), (3, [], [], [], True, "depo"), (4, ["ihale"], [], [], False, "yol"), (5, [], [], [], True, 'tüzük OR "su deposu"'), (6, [], [], [], True, "su -yolu"), (7, [], [], [], True, "su depo"), (8, [], [], [], True, "-su"), (9, [], [], [], True, "koçan")]
    alerts = spark.createDataFrame(rows, "alert_id int, topics array<string>, doc_types array<string>, entity_ids array<long>, is_active boolean, query string")
    records = spark.createDataFrame([(1, ["ihale", "marka"], "x", [5], "su deposu"), (2, [], "yasa", [], "yol"), (3, [], "x", [], "depo"), (4, [], "x", [], "su bir iki üç dört depo yolu"), (5, [], "x", [], "Tapu"), (6, [], "x", [], None)], "id int, topics array<string>, doc_type string, entity_ids array<long>, text string")
    got = sorted((r.alert_id, r.id) for r in L.alert_matches(alerts, records).collect())
    # Words are whole words, without synonyms, wherever they stand.
    assert got == [(1, 1), (2, 1), (2, 2), (3, 3), (3, 4), (5, 1), (6, 1), (7, 4), (8, 2), (8, 3), (8, 5), (8, 6)]
    assert L.alert_matches(alerts.drop("query"), records).count() == 3


def holds(node, text):
    words = text.split()
    if node.kind == "not":
        return not holds(node.parts[0], text)
    if node.kind in ("and", "or"):
        return (all if node.kind == "and" else any)(holds(p, text) for p in node.parts)
    n = len(node.words)
    return any(tuple(words[i : i + n]) == node.words for i in range(len(words) - n + 1))


def test_alert_texts_equal_a_plain_reading(spark):
    rng = random.Random(6)
    words = ["a", "b", "c", "d", "e", "ihale", "su", "yok"]
    texts = [(i, " ".join(rng.choice(words[:-1]) for _ in range(rng.choice([0, 1, 2, 4, 7])))) for i in range(80)] + [(90, None), (91, "a " * 20_000 + "su yok")]

    def part():
        one = rng.choice(words) if rng.random() < 0.7 else '"' + " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3]))) + '"'
        return ("-" if rng.random() < 0.35 else "") + one

    queries = ["-yok", '(a) OR "b c" OR -d', "", None, '"', "-", "a a", "-a a", '-"a b" c', '"a a"', "a-b", "SU OR or"]
    queries += [" OR ".join(" ".join(part() for _ in range(rng.choice([1, 2, 3, 4]))) for _ in range(rng.choice([1, 1, 2, 3]))) for _ in range(60)]
    alerts = spark.createDataFrame(list(enumerate(queries)), "alert_id int, query string")
    got = {tuple(r) for r in L.text_matches(alerts, spark.createDataFrame(texts, "id int, text string")).collect()}
    want = {(k, i) for k, q in enumerate(queries) if (n := S.parse(q)) for i, t in texts if holds(n, S.fold_text(t or ""))}
    assert got == want and len(want) > 1000


def test_reused_summaries(spark):
    rows = [(1, "a", "x", "M", None, "s1"), (2, "a", "x", "M", None, "s2"), (3, "a", "x", "M", None, None), (4, "a", "x", "M", "ae", None)]
    got = L.reuse_summaries(spark.createDataFrame(rows, "id int, title string, doc_type string, section string, ref_type string, summary string")).collect()
    assert [tuple(r) for r in got] == [(3, "s1")]


def test_parameters():
    p = params.parse({"q": [" a ", "b"], "konu": "ihale,marka", "tur": ["yasa"], "yil": "1800", "baslangic": "2025-01-01", "sayfa": "0", "sirala": "odd", "uzak": "1"})
    assert (p.q, p.konu, p.tur, p.yil, p.baslangic, p.sayfa, p.sirala, p.filters()) == ("a", ["ihale", "marka"], ["yasa"], None, "2025-01-01", 1, "yeni", 4)
    assert params.parse({"konu": "ihale,none", "q": "x" * 201}) == params.SearchParams()
    assert p.address() == "/ara?q=a&konu=ihale%2Cmarka&tur=yasa&baslangic=2025-01-01&uzak=1" and params.SearchParams().address() == "/ara"
    assert params.parse({"sayfa": "3"}).offset == 40


def test_alerts_of_common_conditions(spark):
    """Conditions of one alert, of few and of very many, in sets, each pair once; a word of very many records."""
    rng = random.Random(9)
    topics, words = ["ihale", "marka", "atama"], ["su", "yol", "depo"]
    alerts = [(i, rng.sample(topics, rng.choice([0, 1, 2])), [], [i % 50], True, rng.choice([None, "su", "-su", f"w{i % 40}", f"yol OR w{i % 7} OR -depo", 'depo "su yol"'])) for i in range(900)]
    records = [(i, rng.sample(topics, rng.choice([0, 1, 2])), "x", [i % 60], " ".join([*(rng.choice(words) for _ in range(rng.choice([0, 1, 3]))), f"w{i % 45}"])) for i in range(120)]
    found = L.alert_matches(spark.createDataFrame(alerts, "alert_id int, topics array<string>, doc_types array<string>, entity_ids array<long>, is_active boolean, query string"),
                            spark.createDataFrame(records, "id int, topics array<string>, doc_type string, entity_ids array<long>, text string"))
    got = [tuple(r) for r in found.collect()]
    want = {(a[0], r[0]) for a in alerts for r in records if set(a[1]) & set(r[1]) or a[3] == r[3] or ((n := S.parse(a[5])) and holds(n, r[4]))}
    assert sorted(got) == sorted(want)


def test_heavy_words_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(L, "_HEAVY", 3)
    alerts = spark.createDataFrame([(1, "su"), (2, "-depo"), (3, "su yol"), (4, "yol")], "alert_id int, query string")
    texts = [(i, "su" + " depo" * (i % 2) + " yol" * (i % 7 == 0)) for i in range(40)]
    got = sorted(tuple(r) for r in L.text_matches(alerts, spark.createDataFrame(texts, "id int, text string")).collect())
    assert got == sorted([(1, i) for i in range(40)] + [(2, i) for i in range(0, 40, 2)] + [(k, i) for k in (3, 4) for i in range(0, 40, 7)])


def test_no_broadcast_but_of_frequent_words(spark):
    """Stored tables are small as files and large in memory: the driver held them before."""
    alerts = spark.createDataFrame([(i, [], [], [i], True, f"w{i}") for i in range(9)], "alert_id int, topics array<string>, doc_types array<string>, entity_ids array<long>, is_active boolean, query string")
    records = spark.createDataFrame([(i, [], "x", [i], f"w{i}") for i in range(9)], "id int, topics array<string>, doc_type string, entity_ids array<long>, text string")
    found = L.alert_matches(alerts, records)
    assert found.count() == 9 and "Broadcast" not in found._jdf.queryExecution().toString()

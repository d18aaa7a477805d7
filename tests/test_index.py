"""Stored postings against the readings of folded texts, and trigram candidates against all names."""

import random

import pytest
from pyspark.sql import functions as F

from tabulary.functions.text import similarity
from tabulary.operators import index as I
from tabulary.operators import search as S
from tabulary.sources import stored

WORDS = "su sular depo deposu yol yolu ihale imar planlama onayi kocan tapu tuzuk tuzugu yonetmelik zorla mal iktisabi kamulastirma ocak ocagi katma deger vergisi kdv a b c d".split()


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 3, 8, 20])))) for i in range(300)] + [(300, None), (301, " ".join(rng.choice("efgh") for _ in range(50_000)) + " su")]
    return spark.createDataFrame(rows, "id int, text string").select("id", S.search_text(F.col("text")).alias("t")).repartition(3).cache()


@pytest.fixture(scope="module")
def words(texts):
    return I.postings(texts, "id", "t").cache()


def random_query(rng):
    def word():
        return rng.choice([*WORDS, "tüzük", "yo", "dep", "yok"])

    def part():
        kind = rng.random()
        one = word() if kind < 0.7 else '"' + " ".join(word() for _ in range(rng.choice([1, 2, 2, 3]))) + '"'
        return ("-" if rng.random() < 0.2 else "") + one

    return " OR ".join(" ".join(part() for _ in range(rng.choice([1, 1, 2, 2, 3]))) for _ in range(rng.choice([1, 1, 1, 2, 3])))


def test_postings_say_what_texts_say(spark, texts, words):
    rng = random.Random(8)
    asked = ["", '"', "-yok", "su depo", "kamulaştırma su", '"imar su"', "kdv a", "-su OR depo", "e f", "kocan -tapu"] + [random_query(rng) for _ in range(25)]
    plain = texts.select("id", *(c.alias(f"{n}{k}") for k, q in enumerate(asked) for n, c in (("s", S.strict(F.col("t"), q)), ("l", S.loose(F.col("t"), q)), ("d", S.direct(F.col("t"), q))))).collect()
    found = None
    for k, q in enumerate(asked):
        one = I.find(texts.select("id"), words, "id", q).select(F.lit(k).alias("k"), "id", "strict", "direct")
        found = one if found is None else found.unionByName(one)
    got = {(r.k, r.id): (r.strict, r.direct) for r in found.collect()}
    want = {(k, r.id): (bool(r[f"s{k}"]), bool(r[f"d{k}"])) for k in range(len(asked)) for r in plain if r[f"l{k}"]}
    assert got == want and len(want) > 1000


def test_plan_reads_the_letters_of_the_query_only(spark, texts, words, tmp_path):
    words.write.partitionBy("head").parquet(f"{tmp_path}/words")
    read = spark.read.schema(words.schema).parquet(f"{tmp_path}/words")
    plan = I.find(texts.select("id"), read, "id", "su depo")._jdf.queryExecution().executedPlan().toString()
    assert "head#" in plan.split("PartitionFilters: ")[1] and "StringStartsWith(term,su)" in plan and "rlike" not in plan.lower()
    files = I.find(texts.select("id"), read, "id", "su")
    assert files.count() == texts.where(F.col("t").contains(" su")).count()


def test_pages_and_counts(spark, texts, words):
    t = texts.withColumn("n", F.length("t"))
    page = lambda rows: [tuple(r) for r in rows.select("id", "tier").collect()]
    for number in (1, 2):
        assert page(I.tiered_page(t.drop("t"), words, "id", "tapu", [F.desc("n"), F.col("id")], number)) == page(S.tiered_page(t, "t", "tapu", [F.desc("n"), F.col("id")], number))
    assert I.loose_extra(t.drop("t"), words, "id", "su yol").first().extra == S.loose_extra(t, "t", "su yol").first().extra


def test_trigrams_score_candidates_only(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnoprstuvyz"
    names = [(i, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(1, 3)))) for i in range(2000)] + [(2000, None), (2001, ""), (2002, "İhale Kurulu 2024"), (2003, "belediye"), (2004, "belediyesi"), (2005, "xbeledx")]
    df = spark.createDataFrame(names, "id int, name string").withColumn("n", F.col("id") % 5).cache()
    kept = I.trigram_postings(df, "id", "name").cache()
    assert kept.where("bucket is null").count() == 0
    for q in ("belediye", "beled", "ihale kurulu 2024", names[7][1], "ab", "", "zzzz qqq"):
        want = {r.id: round(r.s, 12) for r in df.select("id", similarity(F.col("name"), F.lit(q)).alias("s")).where("s > 0.3").collect()}
        got = {r.id: round(r.similarity, 12) for r in I.similar(kept, q).collect()}
        assert got == want
        near = I.candidates(kept, q, 0.3)
        assert near.count() <= 200 and set(want) <= {r.id for r in near.collect()}
    same = lambda a, b: [tuple(r) for r in a.collect()] == [tuple(r) for r in b.select(a.columns).collect()]
    for q in ("Belediye", "belediyes", "ab", "a", "zz", "hale kur"):
        assert same(I.entity_search(df, kept, "id", "name", "n", q).select("id", "name", "n"), S.entity_search(df, "name", "n", q))
        assert same(I.suggest(df, kept, "id", q, [F.col("id")]).select("id"), S.suggest(df, "name", q, [F.col("id")]))


def test_derived_tables_are_kept_and_forgotten(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/t")
    made = []

    def make(rows):
        return rows.withColumn("by", F.col("id") % 2).withColumn("at", F.lit(len(made)))

    rows = spark.read.parquet(f"{tmp_path}/t")
    first = stored.derived(spark, "twice", rows, make, by="by")
    made.append(1)
    assert {r["at"] for r in stored.derived(spark, "twice", rows, make, by="by").collect()} == {0} and first.count() == 10
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/t")
    assert {r["at"] for r in stored.derived(spark, "twice", spark.read.parquet(f"{tmp_path}/t"), make, by="by").collect()} == {1}
    stored.forget(spark)
    made.append(2)
    assert {r["at"] for r in stored.derived(spark, "twice", spark.read.parquet(f"{tmp_path}/t"), make, by="by").collect()} == {2}


def test_postings_are_not_shuffled_and_words_read_no_places(spark, texts, words, tmp_path):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan(I.postings(texts, "id", "t"))
    words.write.partitionBy("head").parquet(f"{tmp_path}/words")
    read = spark.read.schema(words.schema).parquet(f"{tmp_path}/words")
    assert "places" not in plan(I.find(texts.select("id"), read, "id", "su OR -depo")) and "places" in plan(I.find(texts.select("id"), read, "id", '"su depo"'))

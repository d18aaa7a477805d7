import random
import re

import pytest
from pyspark.sql import functions as F

from tabulary.operators import search as S

DOC = "KAMU HİZMETİ KOMİSYONU VAKIFLAR ÖRGÜTÜ VE DİN İŞLERİ DAİRESİ YÖNETİM KURULU"
FAR = "DİNAMİK PROGRAM ISI TRANSFERİ STATİK CAD TASARIM VE KRİZ MALİ İŞLERİ"


@pytest.mark.parametrize(("how", "text", "query", "want"), [
    (S.strict, DOC, "din işleri", True), (S.strict, DOC, "işleri din", True), (S.strict, FAR, "din işleri", False), (S.loose, FAR, "din işleri", True),
    (S.strict, "TAPU VE KADASTRO DAİRESİ HARÇ VE ÜCRETLER YASASI", "harç ve ücret yasası", True),
    (S.strict, "ZORLA MAL İKTİSABI LEFKOŞA KÖYÜ", "kamulaştırma lefkoşa", True), (S.strict, "MARKA TESCİL İLANI", "kamulastirma", False),
    (S.strict, "ELEKTRİK TARİFELERİ TÜZÜĞÜNDE", "tüzük", True), (S.direct, "KOÇAN İLE İLGİLİ", "tapu", False), (S.direct, "TARİFELERİ TÜZÜĞÜNDE", "tüzük", True),
    (S.strict, "FİYAT İSTİKRAR FONUNA", "fon", True), (S.strict, "bir iki", "iki OR üç", True), (S.strict, "bir iki", "bir -iki", False),
    (S.strict, "bir iki", '"bir iki"', True), (S.strict, "bir ve iki", '"bir iki"', False),
])
def test_match(spark, how, text, query, want):
    assert spark.range(1).select(how(S.search_text(F.lit(text)), query)).first()[0] is want


def test_blank_and_broken_queries(spark):
    assert S.parse("  ") is None and S.parse('"') is None and S.parse("-") is None
    assert spark.range(1).select(S.strict(F.lit(" x "), "")).first()[0] is None
    assert S.plain_words("a b") == ["a", "b"] and S.plain_words("a") is None and S.plain_words("a -b") is None and S.plain_words('a "b"') is None


def test_snippet_and_tokens(spark):
    text, tokens = spark.range(1).select(S.snippet(F.lit("a b İhalesine girdi"), "ihale").alias("s"), S.headline_tokens(F.lit("x \u0001y\u0002 z\u0001q")).alias("t")).first()
    assert text == "\u0001İhalesine\u0002 girdi"
    assert [tuple(t) for t in tokens] == [("x ", 0), ("y", 3), (" z", 0), ("q", 3)]


def plain_snippet(text, query, most=40, least=20, short=3):
    """The rules of ``snippet`` one after the other, for queries of plain words without synonyms."""
    words = " ".join(text.split()).split(" ")
    asked = sorted({w for w in S.fold_text(query).split()})
    fold = ["".join(re.findall("[a-z0-9]+", S.fold_text(w))) for w in words]
    match = [{q for q in asked if f.startswith(q)} for f in fold]
    found = []
    for b in [i for i, m in enumerate(match) if m]:
        for e in range(b, min(len(words), b + most)):
            found.append((-len(set().union(*match[b : e + 1])), e - b, b, e))
    if not found:
        return " ".join(words[:least])
    _, _, b, e = min(found)
    bad = [len(f) <= short and not m for f, m in zip(fold, match, strict=True)]
    at = max(0, b - (most - (e - b + 1)) // 2)
    while at < b and bad[at]:
        at += 1
    end = min(len(words), at + most) - 1
    while end > e and bad[end]:
        end -= 1
    return " ".join(f"<{w}>" if m else w for w, m in list(zip(words, match, strict=True))[at : end + 1])


def test_snippets_take_the_best_stretch(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["an", "su", "İhale", "ihalesi", "kurul", "belediye", "yol,", "b", "büyük-şehir", "(yolu)", "karar"]) for _ in range(rng.choice([0, 1, 5, 30, 90, 200]))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    for q in ("ihale", "ihale yol kurul", "yok", "buyuksehir su"):
        got = {r.id: r.s for r in df.select("id", F.translate(S.snippet(F.col("t"), q), "\u0001\u0002", "<>").alias("s")).collect()}
        assert got == {i: plain_snippet(t, q) for i, t in enumerate(texts)}
    assert df.limit(1).select(S.snippet(F.lit(None).cast("string"), "a"), S.snippet(F.lit("x y"), "")).first()[:] == (None, "x y")


def test_snippets_see_the_whole_text(spark):
    far = " ".join(["uzak"] * 8000)
    texts = [f"{far} ihale kurul", f"ihale {far} kurul - ihale {far}", f"{far} (İhale)si {far} yolu", "x" * 40_000 + " ihale", f"kurul {far} yol ihale kurul"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for q in ("ihale", "ihale kurul yol"):
        got = {r.id: r.s for r in df.select("id", F.translate(S.snippet(F.col("t"), q), "\u0001\u0002", "<>").alias("s")).collect()}
        assert got == {i: plain_snippet(t, q) for i, t in enumerate(texts)}
        assert all("<" in s for s in got.values())
    tokens = df.where("id = 0").select(S.headline_tokens(S.snippet(F.col("t"), "ihale"))).first()[0]
    assert [t.t for t in tokens if t.lvl == 3] == ["ihale"]


@pytest.mark.parametrize(("texts", "query", "want"), [
    ([("a", 1.0), ("b", 0.2)], "a", 1.0), ([("x", 1.0), ("a", 0.2)], "a", 0.2), ([("a", 1.0), ("b", 0.2)], "a b", 2 / (1 + 5)), ([("a x", 1.0), ("y b", 0.2)], "a b", 2 / (1 + 5) / 3),
    ([("", 1.0), ("a a", 0.4)], "a", 0.8), ([("a", 1.0), (None, 0.2)], "a", 1.0), ([("x", 1.0)], "a", 0.0),
])
def test_titles_weigh_more(spark, texts, query, want):
    got = spark.range(1).select(S.weighted_density([(S.search_text(F.lit(t)), w) for t, w in texts], query)).first()[0]
    assert got == pytest.approx(want)


def test_facets_leave_out_their_own_filter(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "p string, q string")
    got = {tuple(r) for r in S.facets(df, {"p": ["a"], "q": ["x"]}).collect()}
    assert got == {("p", "a", 1), ("p", "b", 1), ("q", "x", 1), ("q", "y", 1)}


def test_overlay(spark):
    tokens = F.array(F.struct(F.lit("MUHALEFET İhalesi ve ").alias("t"), F.lit(0).alias("lvl")), F.struct(F.lit("su ihalesi").alias("t"), F.lit(1).alias("lvl")))
    got = spark.range(1).select(S.overlay_matches(tokens, 'ihale "su"').alias("x")).first().x
    assert [tuple(t) for t in got] == [("MUHALEFET ", 0), ("İhale", 3), ("si ve ", 0), ("su", 3), (" ", 1), ("ihale", 3), ("si", 1)]
    assert S.match_terms('ve "bir iki" -üç dört') == ["bir iki", "dort"]


@pytest.mark.parametrize(("text", "query", "want"), [
    ("a b c", "a c", 0.05), ("a c", "c a", 0.1), ("a x a c", "a c", 0.1), ("a c a", "a c", 0.2), ("fon x fonlar", "fon", 0.2), ("a b", "a z", 0.0),
    ("a b", "z OR a", 0.1), ("", "a", 0.0), (None, "a", 0.0), ("a", "", None), ("a b c", '"a b" c', 0.1), ("a", "-b", 0.0),
])
def test_cover_density(spark, text, query, want):
    got = spark.range(1).select(S.cover_density(S.search_text(F.lit(text)), query)).first()[0]
    assert got == (None if want is None else pytest.approx(want))

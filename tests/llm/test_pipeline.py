import itertools
import random

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabulary.llm import decontam, overlap, pieces, pii, quality, simhash


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    kept = quality.keep_stage(spark, docs, folder)
    assert kept.columns == docs.columns
    one = simhash.one_of_each_stage(spark, docs, folder)
    assert one.columns == docs.columns
    prints = [brute.fingerprint(r.text) for r in one.collect()]
    assert len(set(brute.groups(prints))) == len(prints) == len(set(brute.groups([brute.fingerprint(r.text) for r in docs.collect()])))
    clean = decontam.clean_stage(spark, docs, folder)
    assert clean.columns == docs.columns and not {5, 6} & {r.doc_id for r in clean.collect()}
    assert pii.mask_stage(spark, docs, folder).columns == docs.columns
    assert pieces.encode_stage(spark, docs, folder).count() == docs.count()


def test_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    a = sorted(map(repr, docs.collect()))
    b = sorted(map(repr, corpus_pipeline.run(spark, folder).collect()))
    assert a == b and a and docs.where(F.col("n_tokens").isNull()).count() == 0


def test_stages_leave_other_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    names = ("score", "n_words", "hits", "items", "kept_id", "kept_hash", "text_hash", "fp", "root", "spans", "statistics")
    wide = docs.select("*", *(F.lit(n).alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, folder)
        assert got.columns == wide.columns, name
        assert got.drop(*names).exceptAll(stage(spark, docs, folder)).isEmpty(), name
        assert got.where(" or ".join(f"{n} is null or {n} <> '{n}'" for n in names)).isEmpty(), name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, folder).count() == docs.count()


@pytest.mark.parametrize("crowd", [1024, 3])
def test_near_duplicates_by_five_words(spark, crowd, monkeypatch):
    rng = random.Random(3)
    texts = []
    for _ in range(6):
        base = [f"v{rng.randrange(5000)}" for _ in range(200)]
        texts.append(base)
        for changed in (2, 4, 4, 7, 9):
            copy = list(base)
            for at in rng.sample(range(5, 195), changed):
                copy[at] = f"n{rng.randrange(10**9)}"
            texts.append(copy)
    texts = [" ".join(t) for t in texts] + ["İki söz", "i̇ki SÖZ", "iki söz", "", None]
    prints = [brute.fingerprint(t) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := brute.SPACED.findall(brute.lower(t))) else set() for t in texts]
    group, far = list(range(len(texts))), 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        near = (prints[i] ^ prints[j]).bit_count() <= 3
        alike = bool(sets[i]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
        far += alike and not near
        if near or alike:
            group = [group[i] if g == group[j] else g for g in group]
    assert far > 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = {g: i for i, g in reversed(list(enumerate(group)))}
    monkeypatch.setattr(overlap.joined_groups, "__defaults__", (crowd,))
    assert sorted(r.doc_id for r in simhash.one_of_each_stage(spark, docs, "").collect()) == sorted(first.values())

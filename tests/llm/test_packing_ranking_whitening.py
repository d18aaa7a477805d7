"""Packing, ranked search and whitening against plain versions, over odd rows, ties and crowds."""

import collections
import fractions
import math
import random
import re
import zlib

import numpy as np
import pytest
from brute import lower
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabulary.llm import bytepairs, packing, ranking, whitening

TERMS = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def sound(pieces, window):
    """Every sequence is gapless from 0, at most ``window`` long, and hardly padded."""
    by = collections.defaultdict(list)
    for r in pieces:
        by[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert sorted(by) == list(range(len(by)))
    return padding / max(1, window * len(by))


def test_pretokens_equal_the_library(library):
    rng = random.Random(1)
    signs = ["a", "'s", "'", "'re", "ve", "'ll", "'t", " ", "  ", "\n", "\t", "\r\n", "1", "２", "é", "日", "!", "#", " '", " ", "\xa0", "\U0001f600", "ll", "d", "<|endoftext|>", "\x1c", "\x85", "²"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["", "x" * 3000, "word " * 300_000]
    words = bytepairs.vocabulary(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    old, bytepairs.MEMORY = bytepairs.MEMORY, 500
    try:
        for part in (texts[:2000], texts[2000:], texts[:50]):
            ids, edge = words.encode(part)
            want = library.encode_batch(part, add_special_tokens=False)
            assert [ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:], strict=True)] == [e.ids for e in want]
    finally:
        bytepairs.MEMORY = old


def test_packing(spark, docs, pairs, folder, library):
    got = packing.op11_packing(spark, folder).collect()
    assert sound(got, 2048) < 0.01
    whole = collections.defaultdict(list)
    for d, t in pairs:
        whole[d].append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    cut = collections.Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0)
    assert cut == collections.Counter((d, len(x)) for d, xs in whole.items() for x in xs)
    assert sum(r.length for r in got) == sum(len(x) for xs in whole.values() for x in xs)
    for r in got:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in whole[r.doc_id])


@pytest.mark.parametrize("window", [64, 100])
def test_packing_crowds_and_ids(spark, library, window):
    rng = random.Random(window)
    texts = [(i, "ab " * (20 if i % 3 else rng.randint(0, 150))) for i in range(700)] + [(700, "long text " * 4000), (701, None), (701, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("n", F.lit("x")).repartition(5)
    got = packing.pack(df, window=window).collect()
    assert sound(got, window) < 0.01
    have = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r.start):
        have[r.id].append(np.frombuffer(r.ids, "<u4"))
    for d, t in texts:
        if d < 701:
            assert np.concatenate(have[d]).tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 1]
    assert [x.tolist() for x in have[701]] == [[1], [1]]
    cuts = collections.Counter(r.id for r in got if r.id < 700)
    assert sum(k > 1 for k in cuts.values()) < 0.5 * len(texts)


def test_least_squares_uses_the_histogram():
    rng = np.random.default_rng(2)
    window = 200
    histogram = np.zeros(window, np.int64)
    for a in rng.integers(1, 66, 60):
        b = int(rng.integers(a, (window - a) // 2 + 1))
        histogram[[a, b, window - a - b]] += 500
    mixes = packing.combinations(histogram.copy(), window)
    assert (mixes.sum(axis=1) == window).all() and len({tuple(m) for m in mixes.tolist()}) == len(mixes)
    x = packing.repeat_counts(histogram, mixes)
    met = sum(np.bincount(mixes[:, i], weights=x, minlength=window) for i in range(3))
    assert (x >= 0).all() and np.abs(met - histogram)[1:].sum() < 0.02 * histogram.sum()
    plan = packing.make_plan(histogram, window)
    assert plan.used[1:].sum() > 0.98 * histogram.sum()
    # The same minimum as any other solver's: the gradient is zero where x is above zero, else not negative.
    norm = collections.Counter(mixes[5].tolist())
    assert packing.repeat_counts(np.eye(1, window, 3, dtype=np.int64)[0], mixes[5:6])[0] == pytest.approx(norm.get(3, 0) / sum(v * v for k, v in norm.items() if k))


def test_packing_of_nothing(spark, empty):
    assert packing.pack(empty).count() == 0


def ranked(docs, items, k=10):
    words = [(i, d, collections.Counter(TERMS.findall(lower(t)))) for i, (d, t) in enumerate(docs)]
    words = [(i, d, c) for i, d, c in words if c]
    n_docs, length = len(words), sum(sum(c.values()) for _, _, c in words)
    df = collections.Counter(t for _, _, c in words for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, d, c in words:
            m = 25 + 75 * sum(c.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in TERMS.findall(lower(text)) if t in c)
            if s:
                scores.append((-s, d is None, d or 0, i))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d, _) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def test_ranking(spark, folder, pairs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = [(r.item_id, r.rank, r.doc_id, r.score) for r in ranking.op12_ranking(spark, folder).collect()]
    assert sorted(got, key=repr) == ranked(pairs, items)


def test_ranking_of_crowds(spark):
    rng = random.Random(4)
    words = [f"t{int(rng.paretovariate(0.5)) % 300}" for _ in range(4000)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    texts += [(400 + i, texts[3][1]) for i in range(300)] + [(900, " ".join(rng.choice(words) for _ in range(60_000)) + " é" * 600_000), (None, "t1 t2 T3"), (901, None)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(40)] + [(7, texts[3][1]), (None, "t1"), (41, None), (42, "nowhere"), (43, "t1 " * 50)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"m": F.lit("x"), "term": F.lit(1)}).repartition(6)
    queries = spark.createDataFrame(items, "item_id long, text string")
    index = ranking.build_index(df)
    for part_bytes in (1 << 20, 200):
        got = [(r.item, r["rank"], r.id, r.score) for r in ranking.search(index, queries, part_bytes=part_bytes).collect()]
        assert sorted(got, key=repr) == ranked(texts, items)


def test_bounds_hold():
    tf = np.arange(1, 2000)
    for m in (25, 26, 100, 5000, 10**9):
        i = ranking.impacts(tf, np.full(len(tf), m))
        level = -(-i // ranking.UNIT)
        assert (level <= 255).all() and (level * ranking.UNIT >= i).all() and ((i == 0) | ((level - 1) * ranking.UNIT < i)).all()


def test_ranking_of_nothing(spark, empty):
    queries = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranking.search(ranking.build_index(empty), queries).count() == 0
    some = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert ranking.search(ranking.build_index(some), queries.where("false")).count() == 0


def whitened(rows):
    """n, deviations, eigenvalue shares and covariance of the distinct integer vectors, in fractions."""
    x = {i: [min(math.floor(256 * c), (1 << 63) - 1) for c in v] for i, v in rows}
    fit = sorted(set(map(tuple, x.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    far = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in x.items()}
    mean = [fractions.Fraction(s, n) for s in sums]
    cov = [[float(sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in fit) / n) for j in range(len(sums))] for i in range(len(sums))]
    return n, far, np.array(cov), {i: np.array([float(c - m) for c, m in zip(v, mean, strict=True)]) for i, v in x.items()}


@pytest.mark.parametrize("size,scale", [(6, 1.0), (5, 1e7), (3, 1e15)])
def test_whitening(spark, tmp_path, size, scale):
    rng = random.Random(size)
    base = [[scale * rng.gauss(k, 1 + k) for k in range(size)] for _ in range(60)]
    rows = [(i, v) for i, v in enumerate(base)] + [(100 + i, base[0]) for i in range(80)]
    odd = [(200, None), (201, [None] * size), (202, [float("nan")] * size), (203, [float("inf")] * size), (204, []), (205, [1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({"n": F.lit("x"), "id": F.lit(1), "component": F.lit(0)})
    df.repartition(40).write.parquet(f"{tmp_path}/embeddings.parquet")
    old, whitening.FAN_IN = whitening.FAN_IN, 2
    try:
        got = whitening.op13_whitening(spark, str(tmp_path)).collect()
    finally:
        whitening.FAN_IN = old
    n, far, cov, centred = whitened(rows)
    values, axes = np.linalg.eigh(cov)
    k = min(4, size)
    assert len(got) == k * len(rows) and {r.component for r in got} == set(range(1, k + 1))
    signs = {}
    for r in got:
        assert r.n == n and int(r.deviation_digits) == far[r.vec_id]
        assert r.deviation == (far[r.vec_id] if far[r.vec_id] < 1 << 63 else None)
        e = values[-r.component]
        assert r.explained == pytest.approx(e / values.sum(), rel=1e-9) and r.identity_error < 1e-9
        want = centred[r.vec_id] @ axes[:, -r.component] / math.sqrt(e)
        sign = signs.setdefault(r.component, math.copysign(1, want * r.whitened))
        assert r.whitened == pytest.approx(sign * want, rel=1e-7, abs=1e-9)


def test_exact_products():
    rng = random.Random(6)
    for bits in (3, 18, 30, 45, 61, 63):
        x = np.array([[rng.randint(-(1 << bits), (1 << bits) - 1) for _ in range(3)] for _ in range(5000 if bits < 40 else 300)], np.int64)
        sums, products = whitening._moments(x, x[0])
        y = [[a - b for a, b in zip(r, x[0].tolist(), strict=True)] for r in x.tolist()]
        assert sums.tolist() == [sum(c) for c in zip(*y, strict=True)]
        assert products.tolist() == [[sum(r[i] * r[j] for r in y) for j in range(3)] for i in range(3)]
        assert whitening._integers(__import__("pyarrow").array(whitening._bytes(x)), 3).tolist() == x.tolist()


def test_whitening_of_flat_and_no_vectors(spark, tmp_path):
    schema = "vec_id long, embedding array<float>"
    spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 4.0]), (None, [1.0, 2.0])], schema).write.parquet(f"{tmp_path}/a/embeddings.parquet")
    got = {(r.vec_id, r.component): r for r in whitening.op13_whitening(spark, f"{tmp_path}/a").collect()}
    assert len(got) == 6 and abs(got[1, 1].whitened) == pytest.approx(1) and got[1, 2].whitened is None and got[1, 1].explained == pytest.approx(1)
    spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema).write.parquet(f"{tmp_path}/b/embeddings.parquet")
    assert all(r.whitened is None and r.deviation == 0 and r.explained is None for r in whitening.op13_whitening(spark, f"{tmp_path}/b").collect())
    spark.createDataFrame([(1, None)], schema).write.parquet(f"{tmp_path}/c/embeddings.parquet")
    assert whitening.op13_whitening(spark, f"{tmp_path}/c").count() == 0

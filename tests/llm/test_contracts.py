"""Each operator's query against a plain version, over rows with nulls, blanks, copies and ties."""

import hashlib
import math
import random
import zlib

import brute
import heldout_names
import pytest
from pyspark.sql import functions as F

from tabulary.llm import chat, decontam, licences, lm, pieces, pii, quality, registry, rules, simhash, substrings


def ordered(rows):
    return sorted(rows, key=repr)


def taken(df, *names):
    return ordered(tuple(r[n] for n in names) for r in df.collect())


def sentence_of(rng, n):
    return " ".join(f"Word{rng.randrange(90_000)}" for _ in range(n))


@pytest.mark.parametrize("crowd", [4096, 2])
def test_substrings(spark, docs, pairs, crowd):
    got = taken(substrings.repeats(docs, crowd=crowd), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == ordered(brute.substrings(pairs))


def test_substrings_random(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 90)))) for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for crowd in (3, 1000):
        got = taken(substrings.repeats(df, length=8, anchor=4, crowd=crowd), "doc_id", "n_words", "n_removed", "kept_sha256")
        assert got == ordered(brute.substrings(texts, 8))


def test_substrings_of_one_long_text(spark):
    rng = random.Random(21)
    words = [rng.choice("abcdefgh") + str(rng.randrange(60)) for _ in range(300_000)]
    passage = " ".join(words[:60])
    long = " ".join(" ".join(words[i : i + 900]) + " " + passage for i in range(60, 270_000, 900))
    texts = [(1, long), (2, "x " + passage), (3, "la " * 30_000), (4, " ".join(words[5:25]))]
    assert len(long) > 1 << 20
    got = taken(substrings.repeats(spark.createDataFrame(texts, "doc_id long, text string").repartition(2), crowd=16), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == ordered(brute.substrings(texts))


def test_runs_are_whole():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(0, 40, 5000)) // 3
    rest = rng.integers(0, 9, 5000)
    batches = [pa.record_batch({"k": keys[a : a + 70], "v": rest[a : a + 70]}) for a in range(0, 5000, 70)]
    parts = list(substrings._whole_runs(iter(batches), ("k",), rows=200))
    assert np.array_equal(np.concatenate([p.column("v").to_numpy() for p in parts]), rest) and len(parts) > 5
    assert all(a.column("k")[-1] != b.column("k")[0] for a, b in zip(parts, parts[1:], strict=False))


def test_fingerprints(spark, folder, pairs):
    got = taken(simhash.op2_simhash(spark, folder), "doc_id", "fingerprint", "component_id")
    prints = [brute.fingerprint(t) for _, t in pairs]
    root = brute.groups(prints)
    least = {}
    for r, (d, _) in zip(root, pairs, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    assert got == ordered((d, f"{p:016x}", least.get(r)) for (d, _), p, r in zip(pairs, prints, root, strict=True))


@pytest.mark.parametrize("crowd", [2048, 4])
def test_covering_links_lose_no_pair(spark, crowd):
    rng = random.Random(5)
    middle = [rng.getrandbits(64) for _ in range(6)]
    prints = {m ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for m in middle for _ in range(40)}
    prints = sorted(prints | {middle[0] ^ (k << 20) for k in rng.sample(range(1 << 12), 600)})
    nodes = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    edges = [(r.u, r.v) for r in simhash.links(nodes, crowd=crowd).collect()]
    at = {simhash._signed(p): i for i, p in enumerate(prints)}
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for u, v in edges:
        assert (u ^ v) == 0 or at[u] != at[v]
        a, b = find(at[u]), find(at[v])
        parent[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(prints))] == brute.groups(prints)


def test_shingle_hashes():
    import numpy as np
    import xxhash

    from tabulary.llm import shingles

    rng = random.Random(1)
    texts = ["", " ", "a", "a b", "é\tB c", "x" * 5000] + [" ".join("".join(rng.choice("aBcé日") for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 30, 60, 150]))) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    for width in (1, 3, 5):
        h, first = shingles.shingle_hashes(data, offsets, width)
        names, _ = shingles.word_sets(data, offsets, width)
        want = []
        for t in texts:
            w = t.encode().lower().split()
            want += [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
        assert h.tolist() == [xxhash.xxh64_intdigest(x, 42) for x in want] and first[-1] == len(want)
        assert len(set(zip(names.tolist(), want, strict=True))) == len(set(want)) == len(set(names.tolist()))


def test_fingerprint_of_a_long_text():
    import pyarrow as pa

    rng = random.Random(2)
    texts = ["a", sentence_of(rng, 300_000), None, sentence_of(rng, 40), ""]
    assert [x % (1 << 64) for x in simhash.prints_of(pa.array(texts)).to_pylist()] == [brute.fingerprint(t) for t in texts]


def test_large_buckets_look_up_neighbours():
    import numpy as np

    rng = random.Random(9)
    x = np.array(sorted((7 << 30) | k for k in rng.sample(range(1 << 16), 2600)), np.int64)
    old = simhash.CROWD
    try:
        simhash.CROWD = 5000
        want = sorted(simhash._links(x, 3))
        simhash.CROWD = 100
        assert sorted(simhash._links(x, 3)) == want
    finally:
        simhash.CROWD = old


def test_masks_cover_every_pair():
    rng = random.Random(1)
    masks = simhash.covering_masks()
    for _ in range(2000):
        flips = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(m & flips == 0 for m in masks)


def test_quality(spark, folder, docs, pairs):
    got = quality.op3_quality(spark, folder).collect()
    assert len(got) == len(pairs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.add_score(docs, quality.fit(docs, none)).collect()} == {0.5}


def test_quality_learns(spark):
    rng = random.Random(2)
    good = [(i, " ".join(f"w{rng.randint(0, 900)}" for _ in range(80)), 1) for i in range(0, 400, 2)]
    bad = [(i, " ".join(f"w{rng.randint(0, 900)}###" for _ in range(80)), 0) for i in range(1, 400, 2)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    scored = quality.add_score(df, quality.fit(df, df)).where(quality.remainder() == 0).collect()
    assert len(scored) > 50 and all((r.score >= 0.5) == (r.quality == 1) for r in scored)


def test_rule_counts(spark, folder, pairs):
    got = taken(rules.op4_rules(spark, folder), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for d, t in pairs:
        c = brute.counts(t)
        want.append((d, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert got == ordered(want)
    kept = rules.op4_rules(spark, folder).where("kept").collect()
    assert kept and not any(r.base_failed for r in kept)


def test_rules_judge_like_a_plain_determinant(spark):
    rng = random.Random(21)
    rows = []
    for i in range(700):
        group = i % 3
        words = [f"w{rng.randint(0, 10 ** rng.randint(1, 6))}" for _ in range(rng.randint(55, 160))]
        if rng.random() < 0.15:
            words = [w + rng.choice(("#", "$$$", "%%%%%%%%", "")) for w in words]
        text = " ".join(words) if group else "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))
        if rng.random() < 0.1:
            text += "\n" + "\n".join([" ".join(words[:9])] * rng.randint(1, 6))
        rows.append((i, text, ("en", None, "de")[group], "s" if group else None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = {r.doc_id: r for r in rules.judge(df).collect()}
    groups = {}
    for i, text, lang, source in rows:
        n, chars, symbols, dup, repeat = brute.counts(text)
        failed = n < 50 or 100 * repeat > 50 * n
        assert got[i].base_failed == failed
        lines = sum(bool(x.split()) for x in text.split("\n"))
        if not failed:
            groups.setdefault((lang, source), []).append((i, [chars / n, min(symbols / chars, 1) ** 0.5, min(dup / lines, 1) ** 0.5, min(repeat / n, 1) ** 0.5]))
    apart = 0
    for members in groups.values():
        for (i, _), d in zip(members, brute.robust_distances([x for _, x in members], rules.FLOOR, rules._BINS), strict=True):
            assert abs(got[i].distance - d) < 1e-6 * max(1, d) and got[i].kept == (d <= rules.CHI2_CUT)
            apart += d > rules.CHI2_CUT
    assert len(groups) == 3 and 10 < apart < 300


def test_quality_and_rules_of_very_long_texts(spark):
    import collections

    rng = random.Random(31)
    words = [f"Word{rng.randrange(90_000)}" for _ in range(150_000)]
    long = "\n".join(" ".join(words[i : i + 50]) for i in range(0, 150_000, 50)) + "\n" + " ".join(words[:50]) + " # end"
    assert len(long) > 1 << 20
    df = spark.createDataFrame([(1, long, "en", "s"), (2, long, "en", "s"), (3, "a b", "en", "s")], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in rules.judge(df).collect()}
    w = long.split()
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    marked = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    assert (got[1].n_words, got[1].n_symbols, got[1].n_dup_lines, got[1].n_repeat_words) == (len(w), 1, 0, len(marked)) and got[1].distance == got[2].distance
    none = spark.createDataFrame([], "doc_id long, quality int")
    scored = quality.add_score(df, quality.fit(df, none)).collect()
    assert len(scored) == 3 and scored[0].score == scored[1].score


def test_rules_find_the_least_determinant(spark):
    import itertools

    import numpy as np

    rng = np.random.default_rng(8)
    groups, floor = {}, (0.01, 0.01, 0.01, 0.01)
    for g in range(6):
        x = rng.normal(0, 1, (12, 4)) * rng.uniform(0.3, 1.5, 4) + rng.uniform(-2, 2, 4)
        x[: g % 4] += rng.uniform(4, 9, 4)
        groups[g] = x
    rows = spark.createDataFrame([(g, *map(float, v)) for g, x in groups.items() for v in x], "lang int, x0 double, x1 double, x2 double, x3 double")
    got = {r.lang: r for r in rules.robust_estimates(rows, ["lang"], floor).collect()}
    exact = 0
    for g, x in groups.items():
        least = min((np.linalg.slogdet(np.cov(x[list(s)].T, bias=True) + np.diag(floor))[1], s) for s in itertools.combinations(range(12), 9))
        found = 2 * sum(math.log(got[g][f"c{i}{i}"]) for i in range(4))
        assert least[0] - 1e-9 <= found <= least[0] + 0.7
        exact += found < least[0] + 1e-6
        if g % 4:
            assert not set(least[1]) & set(range(g % 4))
            assert all(abs(got[g][f"m{i}"] - x[g % 4 :, i].mean()) < 0.8 for i in range(4))
    assert exact >= 3


def test_rules_reject_what_lies_apart(spark):
    rng = random.Random(4)
    clean = [(i, " ".join(f"word{rng.randint(0, 4000)}" for _ in range(rng.randint(60, 200)))) for i in range(300)]
    odd = [(1000 + i, " ".join(f"wo{rng.randint(0, 4000)}###$$$" for _ in range(100))) for i in range(12)]
    df = spark.createDataFrame([(*r, "en", "s") for r in clean + odd], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in rules.judge(df).where("kept").collect()}
    assert kept == {i for i, _ in clean}


def test_chat_reads_back(spark):
    texts = ["plain", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nx", "<\\|im_end|>", "a\\b", "", "<<SYS>> <\\\\/s>", "\n"]
    rows = spark.createDataFrame([(i,) for i in range(len(texts))], "i int")
    turns = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(t).alias("text")) for t in texts for r in ("user", "assistant", "a\\n<|im_end|>\nb")))
    out = chat.add_loss_mask(rows.limit(1).withColumn("formatted", chat.format_turns(turns))).first()
    assert len(out.segments) == 3 * len(texts)
    read = spark.createDataFrame([(out.formatted,)], "formatted string").select(F.transform(chat.read_segments(F.col("formatted")), lambda s: F.struct(s["role"], chat.unescape(s["body"])))).first()[0]
    assert [tuple(r) for r in read] == [(r, t) for t in texts for r in ("user", "assistant", "a\\n<|im_end|>\nb")]
    assert [out.formatted[s.begin : s.end] for s in out.loss_spans] == [s.body for s in out.segments if s.role == "assistant"]


def test_chat_layouts(spark):
    records = [
        '{"messages":[{"role":"user","content":"a"},{"content":"b","role":"assistant"}]}', '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}',
        '{"prompt":"a","completion":"b"}', '{"output":"b","instruction":"a","input":""}', '{"dialog":{"turns":[{"speaker":"user","utterance":"a"},{"speaker":"assistant","utterance":"b"}]}}',
        '{"unknown":1}', "no json", None,
    ]
    got = chat.canonical_turns(spark.createDataFrame([(r,) for r in records], "record string")).collect()
    assert [r.layout for r in got] == ["messages", "conversations", "prompt", "instruction", "dialog", None, None, None]
    assert all([tuple(t) for t in r.turns] == [("user", "a"), ("assistant", "b")] for r in got[:5]) and all(r.turns is None for r in got[5:])
    prints = [r.fingerprint for r in got]
    assert len(set(prints[:6])) == 6 and prints[6:] == [None, None]


def test_chat_tolerates_other_keys_and_long_strings(spark):
    ab, plain = [("user", "a"), ("assistant", "b")], lambda r: [tuple(t) for t in r.turns]
    records = [
        '{"prompt":"a","completion":"b","id":7,"meta":{"source":["x"]}}', '{"messages":[{"role":"user","content":"a","name":"n"},{"role":"assistant","content":"b"}],"model":null}',
        '{"instruction":"a","input":null,"output":"b"}', '{"instruction":"a","response":"b","tags":[]}', '{"prompt":"a","response":"b"}', '{"question":"a","answer":"b","score":0.5}',
    ]
    got = chat.canonical_turns(spark.createDataFrame([(r,) for r in records], "record string")).collect()
    assert [plain(r) for r in got] == [ab] * len(records)
    assert [r.layout for r in got] == ["prompt", "messages", "instruction", "instruction_response", "prompt_response", "question"]
    more = ['{"system":"s","messages":[{"role":"user","content":"a"}]}', '{"prompt":"a","completion":null}', '{"messages":[]}', '{"prompt":"a","messages":[{"role":"user","content":"a"}]}']
    got = chat.canonical_turns(spark.createDataFrame([(r,) for r in more], "record string")).collect()
    assert [r.layout for r in got] == ["system_messages", "prompt", None, None] and plain(got[0]) == [("system", "s"), ("user", "a")] and plain(got[1]) == [("user", "a"), ("assistant", "")]
    long = spark.range(1).select(F.concat(F.lit('{"id":1,"prompt":"'), F.repeat(F.lit("ab"), 10_500_000), F.lit('","completion":"b"}')).alias("record"))
    r = chat.canonical_turns(long).select("layout", F.length(F.get("turns", F.lit(0))["text"]), F.get("turns", F.lit(1))["text"], "fingerprint").first()
    assert tuple(r)[:3] == ("prompt", 21_000_000, "b") and r.fingerprint is not None
    structs = spark.createDataFrame([("a", "b")], "q string, r string")
    assert plain(chat.structured_turns(structs, question=F.col("q"), answer=F.col("r")).first()) == ab


def test_chat_query_uses_the_mapping(spark, folder_of_conversations):
    plan = chat.op5_chat(spark, folder_of_conversations)._jdf.queryExecution().executedPlan().toString()
    assert all(x in plan for x in ("xxhash64", "turns[].role", "segment")) and "Python" not in plan


@pytest.fixture
def folder_of_conversations(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_chat_masks_many_turns(spark):
    turns = [("assistant" if i % 3 else "user", f"t{i} <|im_end|> é" * (i % 5)) for i in range(5000)]
    df = spark.createDataFrame([(turns,), ([],)], "turns array<struct<role:string,text:string>>")
    got = chat.add_loss_mask(chat.with_format(df)).withColumn("loss", chat.text_under_mask(F.col("segments"), F.col("loss_spans"))).collect()
    assert got[0].loss == "".join(t for r, t in turns if r == "assistant") and got[1].loss == "" and got[1].loss_spans == []
    assert [got[0].formatted[s.begin : s.end] for s in got[0].loss_spans] == [s.body for s in got[0].segments if s.role == "assistant"]


def test_chat_gathers_odd_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", None), (1, 0, None, "x"), (1, 0, None, "x"), (None, 1, "user", "y")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.format_conversations(rows).collect()}
    assert got == {1: [("", "x"), ("", "x"), ("user", "")], None: [("user", "y")]}


def test_chat_keeps_turns_beyond_the_parsers_limits(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "x"), (1, 0, "human", "y")], "conv_id long, turn long, role string, text string")
    long = rows.withColumn("text", F.when(F.col("turn") == 0, F.repeat(F.lit("ab"), 10_500_000)).otherwise(F.col("text")))
    got = chat.format_conversations(long).select("layout", F.size("turns"), F.transform("turns", lambda t: t["role"]), F.length("formatted")).first()
    assert tuple(got) == ("turns", 2, ["user", "assistant"], 21_000_001 + len("user") + len("assistant") + 48)


def test_licences(spark):
    texts = ["text\nLicensed under the apache license -- version 2.0\nmore", "Released under the MIT License", None, "", "Licensed under CC BY NC 4.0", "The quick brown fox jumps over it all"]
    got = licences.scan(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [sorted({m.licence for m in r.matches}) for r in got] == [["apache-2.0"], ["mit"], [], [], ["cc-by-nc-4.0"], []]
    mit = dict(licences.TEMPLATES[4:5])["mit"]
    bsd = next(t for n, t in licences.TEMPLATES if n == "bsd-3-clause")
    commented = "\n".join("# " + line for line in mit.replace(". ", ".\n").split("\n"))
    texts = ["Some prose first. Licensed under the MIT License. More prose ...", mit.split("\n\n")[1], mit.split("\n\n")[2], f"Prose before it.\n{mit.replace(chr(10), ' ')} And prose after it, of many words.",
             commented, "x " * 300 + ".\n\n" + bsd + "\n\n" + "y " * 200, "In no event shall the author be late; the software is provided by mail and the terms apply."]
    got = licences.scan(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [{m.licence for m in r.matches} >= {w} for r, w in zip(got, ["mit"] * 5 + ["bsd-3-clause"], strict=False)] == [True] * 6 and not got[6].matches
    assert max(m.dice for m in got[4].matches) > 0.95
    assert licences.scan(spark.createDataFrame([("x",)], "text string"), templates=()).first().matches == []
    for n in range(2, 60):
        a = set(range(n))
        for m in range(1, 120):
            best = 2 * min(n, m) / (n + m)
            assert (m in licences.size_bounds(n, 0.8)) == (best >= 0.8 - 1e-12), (n, m, len(a))


def test_licences_are_told_apart(spark):
    whole = "\n\n".join(t for n, t in licences.TEMPLATES if t.startswith("GNU GENERAL PUBLIC LICENSE Version 3"))
    texts = {
        "This project is licensed under the terms of the MIT license.": {"mit"}, "// SPDX-License-Identifier: MIT\nint main() {}": {"mit"}, "# SPDX-License-Identifier: ISC": {"isc"},
        "SPDX-License-Identifier: GPL-3.0-or-later": {"gpl-3.0"}, "SPDX-License-Identifier: GPL-2.0-only": {"gpl-2.0"}, "SPDX-License-Identifier: BSD-2-Clause": {"bsd-2-clause"},
        "x\n\n\"Licensor\" shall mean the copyright owner or entity authorized by\nthe copyright owner that is granting the License.\n\ny": {"apache-2.0"},
        "Preamble\n\n  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.": {"gpl-3.0"},
        "The widget project is licensed under the terms of the Apache License, Version 2.0.": {"apache-2.0"}, "SPDX identifies a license by its identifier.": set(),
        "The parties are licensed under the terms of the agreement.": set(), "a" * 10 + " word" * 250_000 + "\n\n" + whole: {"gpl-3.0"},
    }
    got = licences.scan(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert len(max(texts, key=len)) > 1 << 20
    assert {r.text: {m.licence for m in r.matches} for r in got} == texts


def test_language_model(spark, folder, pairs):
    got = ordered((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.op7_lm(spark, folder).collect())
    want = brute.language_model(pairs)
    assert got == ordered((*w[:5], round(w[5], 6)) for w in want)
    scores = ordered((r.doc_id, r.n_tokens, round(r.base_score, 6), r.score) for r in lm.op7_lm(spark, folder).collect())
    for a, b in zip(scores, ordered((w[0], w[2], round(w[5], 6), w[6]) for w in want), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 0.001 * a[1]


def test_language_model_spreads_frequent_contexts(spark, monkeypatch):
    rng = random.Random(14)
    texts = [(i, " ".join("the cat" if rng.random() < 0.3 else rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.randint(0, 120)))) for i in range(300)]
    texts.append((300, " ".join("the cat" if rng.random() < 0.3 else f"x{rng.randrange(30_000)}" for _ in range(750_000))))  # a block of its own
    monkeypatch.setattr(lm, "_SAMPLE", 1)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3, "doc_id")
    busy, shards = lm.busy_contexts(docs, 7)
    assert len(busy.names) >= 3 and shards == 14 and len(texts[-1][1]) > lm.BLOCK_BYTES
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = {r.doc_id: r for r in lm.score(docs, held).collect()}
    for w in brute.language_model(texts):
        r = got[w[0]]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[1:5] and abs(r.base_score - w[5]) < 1e-6 * r.n_tokens
        assert abs(r.score - w[6]) < 0.001 * r.n_tokens


def test_elias_fano():
    import numpy as np

    from tabulary.llm import eftrie

    rng = np.random.default_rng(0)
    for top in (0, 3, 1000, 1 << 40):
        values = np.sort(rng.integers(0, top + 1, 700))
        assert (eftrie.EliasFano.encode(values).access(np.arange(700)) == values).all()
    keys = np.unique(rng.integers(0, 1 << 20, 4000).astype(np.uint64) | (rng.integers(0, 50, 4000).astype(np.uint64) << np.uint64(32)))
    below = np.unique((rng.integers(0, len(keys), 3000).astype(np.uint64) << np.uint64(32)) | rng.integers(0, 90, 3000).astype(np.uint64))
    trie = eftrie.Trie([(50, keys, np.arange(len(keys), dtype=np.uint16)), (len(keys), below, np.ones(len(below), np.uint16))])
    for level, have in enumerate((keys, below)):
        ask = np.concatenate([have, have ^ np.uint64(1)])
        place = trie.find(level, (ask >> np.uint64(32)).astype(np.int64), ask & np.uint64((1 << 32) - 1))
        assert (place == np.where(np.isin(ask, have), np.searchsorted(have, ask), -1)).all()
    assert trie.find(1, np.array([-1, 0]), np.array([0, 91])).tolist() == [-1, -1] and trie.codes(0, np.array([5, -1])).tolist() == [5, 0]
    trie.close()
    p = np.array([1.0, 0.3, 1e-4, 1e-8, 1e-15])
    assert np.allclose(np.log10(eftrie.dequantise(eftrie.quantise(p))), np.log10(p), atol=0.0002)


def test_pii_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("a@.1+ -()2b_9.@45é%") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute.pii(text)
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 200_000) == []


def test_pii_query(spark, folder, pairs):
    got = taken(pii.op8_pii(spark, folder), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    want = []
    for d, t in pairs:
        s = brute.pii(t)
        want.append((d, *(sum(x[0] == k for x in s) for k in pii.BASE), brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in s))))
    assert got == ordered(want)


def test_pii_names_and_masks(spark):
    texts = ["Hello, my name is Karen Walker and I live at 55 Elm Street. Mail x@y.org", "Thntblere of then, edtioner in inea.", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    spans = [r.spans for r in pii.find_pii(df).collect()]
    assert [(s.kind, texts[0][s.begin : s.end]) for s in spans[0]] == [("email", "x@y.org"), ("name", "Karen Walker"), ("address", "55 Elm Street")]
    assert spans[1:] == [[], [], []]
    assert [r.text for r in pii.mask_pii(df).collect()] == ["Hello, my name is [name] and I live at [address]. Mail [email]", *texts[1:]]
    assert pii.masked("abcdef", [("card", 1, 4), ("phone", 2, 5)]) == "a[card]f"


def test_names_in_sentences_that_the_field_never_saw():
    import pyarrow as pa

    rows = list(heldout_names.parsed())
    right = given = wanted = 0
    for (_, want), got in zip(rows, pii.all_spans(pii.trained(), pa.array([t for t, _ in rows])), strict=True):
        right, given, wanted = right + len(set(want) & set(got)), given + len(got), wanted + len(want)
    assert wanted > 80 and right / given >= 0.9 and right / wanted >= 0.9
    plain = ["My name is Łukasz Nowak and I work here.", "Ms. Linda Chen called.", "The invoice was paid by Sarah Connor.", "John Smith went to Paris."]
    got = [[t[a:b] for _, a, b in s] for t, s in zip(plain, pii.all_spans(pii.trained(), pa.array(plain)), strict=True)]
    assert got == [["Łukasz Nowak"], ["Linda Chen"], ["Sarah Connor"], ["John Smith"]]


def test_spans_of_long_texts_take_linear_time():
    import time

    import pyarrow as pa

    text = "é Dear John Smith, write to a.b@c.de or 1.2.3.4 please.\n" * 40_000
    began = time.perf_counter()
    spans = pii.all_spans(pii.trained(), pa.array([text]))[0]
    assert len(text) > 2 << 20 and time.perf_counter() - began < 60
    assert [(k, text[a:b]) for k, a, b in spans if k == "name"] == [("name", "John Smith")] * 40_000
    rng = random.Random(4)
    for _ in range(300):
        base = [("x", a, a + rng.randint(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randint(0, 6)))]
        edges = sorted(rng.sample(range(60), 8))
        more = [("name", a, b) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        assert pii._outside(base, more) == [m for m in more if all(m[2] <= a or b <= m[1] for _, a, b in base)]


def test_pieces(spark, folder, pairs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary_path())
    want = []
    for d, t in pairs:
        ids = library.encode(t or "")
        want.append((d, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids))))
    assert taken(pieces.op9_pieces(spark, folder), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == ordered(want)


def test_piece_spans_tile_the_text():
    texts = ["", " ", "  a  b", "é 日本 \U0001f600", "x\ty\n▁▁z ", "a" * 3000]
    ids, begins, ends = pieces.encoder(pieces.vocabulary_path()).encode(texts)
    for text, i, b, e in zip(texts, ids, begins, ends, strict=True):
        assert len(i) == len(b) == len(e)
        if len(i):
            assert b[0] == 0 and e[-1] == len(text.encode()) and (b[1:] == e[:-1]).all()


MAPPED = ["", " ", "  Ａｂ①  ㌔ é x ", "ﬁne ﬂow\u00a0\u3000x\t\ny", "e\u0301 ½ Å \u212b", "日本 ｶﾞｷﾞ \U0001f600", "\u200b a \u200b", "a" * 3000, "ＡＢ<sep>Ｃ <sep>", "▁ ▁", "\u200b", " \u200b "]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nfkc", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_normaliser_aligns_as_the_compiled_map_says(rule, squeeze):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=squeeze).serialized_model_proto())
    proto.normalizer_spec.remove_extra_whitespaces = squeeze
    library, own = sentencepiece.SentencePieceNormalizer(model_proto=proto.SerializeToString()), pieces.Normaliser(proto.normalizer_spec)
    rng = random.Random(6)
    for text in [*MAPPED, *("".join(rng.choice("Ａｂ ①㌔ é\u0301\u3000\u200bｶﾞﬁ\n▁x") for _ in range(rng.randint(0, 30))) for _ in range(400))]:
        want, at = library.normalize(text, with_offsets=True)
        out, origin = own.align(text.encode())
        assert out.decode() == want, text
        if want:
            bytes_of = [len(text[:k].encode()) for k in range(len(text) + 1)]
            edges = [len(want[:k].encode()) for k in range(len(want) + 1)]
            assert [int(origin[e]) for e in edges] == [bytes_of[k] for k in at], text


@pytest.mark.parametrize("suffix", [False, True])
def test_mapped_models_give_the_librarys_ids(suffix):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(pieces.vocabulary_path(), "rb").read())
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    proto.normalizer_spec.CopyFrom(spec.normalizer_spec)
    proto.trainer_spec.treat_whitespace_as_suffix = suffix
    for at, symbol in ((31998, "<sep>"), (31999, "Ａ")):
        proto.pieces[at].piece, proto.pieces[at].type = symbol, sentencepiece_model_pb2.ModelProto.SentencePiece.USER_DEFINED
    library, own = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString()), pieces.Encoder(proto.SerializeToString())
    rng = random.Random(8)
    texts = MAPPED + ["".join(rng.choice(["Ａ", "ｂ", " ", "①", "<sep>", "word", "é", "\u3000", "<s", "ep>", "\n"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    ids, begins, ends = own.encode(texts)
    assert [x.tolist() for x in ids] == library.encode(texts)
    for text, i, b, e in zip(texts, ids, begins, ends, strict=True):
        raw = text.encode()
        assert all(raw[x:y].decode() in ("<sep>", "Ａ") for k, x, y in zip(i, b, e, strict=True) if k >= 31998)


def test_unknown_pieces_have_spans():
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(pieces.vocabulary_path(), "rb").read())
    kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
    for p in proto.pieces:
        if p.type == kinds.BYTE:
            p.type = kinds.UNUSED
    proto.trainer_spec.byte_fallback = False
    ids, begins, ends = pieces.Encoder(proto.SerializeToString()).encode(["word \U00013000\U00013001 end"])
    k = ids[0].tolist().index(0)
    assert (begins[0][k], ends[0][k]) == (5, 13) and ends[0][-1] == 17


def test_piece_stage_takes_long_texts(spark):
    df = spark.createDataFrame([(1,), (2,)], "doc_id long").withColumn("text", F.when(F.col("doc_id") == 1, F.repeat(F.lit("long texts "), 200_000)).otherwise("x"))
    got = {r.doc_id: r for r in pieces._digest(df).collect()}
    assert got[1].span_end == 2_200_000 and got[1].decoded_sha256 == brute.sha("long texts " * 200_000) and got[2].span_end == 1


def test_decontamination(spark, folder, pairs):
    items = [(1, pairs[5][1]), (2, "W3 w4"), (3, None), (4, "")]
    got = taken(decontam.op10_decontaminate(spark, folder), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == ordered(brute.contamination(pairs, items))


def test_decontamination_random(spark):
    rng = random.Random(11)
    words = lambda n, kinds: " ".join(f"K{rng.randrange(kinds)}" for _ in range(n))
    items = [(i, words(rng.choice((1, 2, 5, 9, 10, 14, 30)), rng.choice((3, 40, 300)))) for i in range(30)]
    items += [(3, items[4][1]), (None, words(25, 300)), (None, "la " * 15), (None, None)]
    texts = [None, "", "la " * 400, " ".join(t for _, t in items if t)]
    texts += [words(rng.randint(0, 60), rng.choice((3, 40, 300))) + " " + (rng.choice(items)[1] or "") + "\n" + words(rng.randint(0, 60), 300) for _ in range(60)]
    texts.append(words(800_000, 100_000) + " " + items[7][1] + " " + items[-3][1] + " " + words(50_000, 9))  # a block of its own
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find_phrases(docs, benchmark)
    index = decontam.build_index(docs)
    parted = decontam._all_texts(index, decontam.phrases(decontam.find(index, benchmark, slop=None, part_bytes=20_000)))
    assert taken(parted, "doc_id", "n_words", "hits", "items") == taken(found, "doc_id", "n_words", "hits", "items")
    got = ordered((r.doc_id, r.n_words, sum(r.hits[1::2]) - sum(r.hits[::2]), brute.sha(",".join(r["items"]))) for r in found.collect())
    want = brute.contamination(list(enumerate(texts)), items)
    assert len(texts[-1]) > decontam.BLOCK_BYTES and want[-1][2] > 0
    assert got == ordered((*w[:3], w[4]) for w in want)


def test_proximity_random(spark):
    rng = random.Random(12)
    texts = [" ".join(f"k{rng.randrange(12)}" for _ in range(rng.randint(0, 50))) for _ in range(40)]
    items = [(i, " ".join(f"K{rng.randrange(13)}" for _ in range(rng.randint(0, 6)))) for i in range(25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = decontam.find_near(docs, spark.createDataFrame(items, "item_id long, text string"), slop=2).collect()
    for r in rows:
        inside, terms = texts[r.doc_id].split()[r.begin : r.end], set(items[int(r["item"])][1].lower().split())
        assert terms <= set(inside) and len(inside) <= len(terms) + 2
    assert {(r.doc_id, int(r["item"])) for r in rows} == set(brute.near(list(enumerate(texts)), items, 2))


def test_decontamination_keeps_items_without_id(spark, pairs, tmp_path):
    at = str(tmp_path)
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(None, pairs[5][1]), (2, "W3 w4")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    got = taken(decontam.op10_decontaminate(spark, at), "doc_id", "n_words", "n_hit", "contaminated")
    want = brute.contamination(pairs, [(1, pairs[5][1]), (2, "W3 w4")])
    assert got == ordered((*w[:3], w[5]) for w in want)
    found = [(r.n_items, r.items_sha256) for r in decontam.op10_decontaminate(spark, at).where("doc_id = 5").collect()]
    w3 = " w3 w4 " in f" {pairs[5][1]} "
    assert found == [(int(w3), brute.sha("2" if w3 else ""))] * 2
    assert not {5, 6} & {r.doc_id for r in decontam.clean_stage(spark, docs, at).collect()}


def test_proximity_of_frequent_terms(spark):
    docs = spark.createDataFrame([(i, "the end of " * 667) for i in range(40)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the"), (2, "the end"), (3, "end")], "item_id long, text string")
    got = decontam.find_near(docs, items).groupBy("item", (F.col("end") - F.col("begin")).alias("size")).count().collect()
    assert {(r.item, r.size, r["count"]) for r in got} == {("1", 1, 40 * 667), ("2", 2, 40 * 667), ("3", 1, 40 * 667)}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x Alpha y beta gamma z"), (2, "alpha " + "q " * 20 + "beta gamma"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "gamma beta alpha"), (8, "zeta")], "item_id long, text string")
    assert [tuple(r) for r in decontam.find_near(docs, items, slop=3).collect()] == [(1, "7", 1, 5)]


def test_empty_tables(spark, empty, tmp_path):
    at = str(tmp_path)
    empty.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    for name, f in registry.queries().items():
        assert f(spark, at).count() == (1 if name == "op5_chat" else 0), name


def test_digest_helper():
    assert brute.sha("") == hashlib.sha256(b"").hexdigest()

"""Search over stored postings: words with their places, and trigrams of names.

``postings`` has a row for each word and block of texts, in a folder for each first letter and
sorted by word within: the words of a query are ranges of it, so a scan reads the folders of
their letters and, in those, the row groups that may hold them. A text meets a query only
through the words they share: places are gathered by text, phrases are intersections of
shifted places, and neighbours are places at most ``near`` apart. Texts of queries that hold
without any word (``-a``) come from the table of texts, and from there only.

``trigram_postings`` has a row for each trigram and name, with the number of the name's
trigrams. A name can only be similar enough if it has one of the query's rarest trigrams and
a fitting number of them; only such candidates are counted.

Readings of a query are those of ``search``: strict, loose and direct. Ids are keys of their
tables; rows with a null id are found by no word.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulary.functions.text import trigrams
from tabulary.operators.search import BRIDGES, NEAR, SYNONYMS, Node, fold_text, parse

BLOCK_BYTES = 2 << 20
_BUCKETS = 32


@dataclass(frozen=True, order=True)
class Token:
    """A word, or the beginning of one."""

    text: str
    prefix: bool


def postings(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(head, term, block, ids, ends, places) of folded texts (``search.search_text``), to be stored by ``head``.

    A row has the ids of the texts of a block that have the word, one after the other where in each it
    stands, and where in these places each text's end (null if it stands once in each). A block is some ``BLOCK_BYTES`` of one partition's
    texts, or one longer text. Nothing is shuffled: each partition of texts sorts its own words, and
    so makes a file for each first letter."""
    rows = texts.select(F.col(id_col).alias("id"), F.trim(text_col).alias("text"))
    key = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(key)),
                           T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("places", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK_BYTES, side="right")))
                part = batch.slice(lo, hi - lo)
                term, *lists = _block(part.column("id"), part.column("text"))
                yield pa.RecordBatch.from_arrays([term, pa.array(np.full(len(term), block)), *lists], names=schema.names)
                lo, block = hi, block + 1

    return rows.mapInArrow(run, schema).withColumn("head", F.left("term", F.lit(1))).sortWithinPartitions("head", "term", "block")


def _block(ids: pa.Array, texts: pa.Array) -> tuple[pa.Array, ...]:
    """The distinct words of some texts, and for each the ids, ends and places."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
    size = pc.list_value_length(lists).to_numpy()
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy()
    doc = np.repeat(np.arange(len(size)), size)
    place = (np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
    order = np.flatnonzero(code != coded.dictionary.index("").as_py())
    order = order[np.argsort(code[order], kind="stable")]
    code, doc, place = code[order], doc[order], place[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    code, doc = code[first], doc[first]
    edge = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]])) if len(code) else np.zeros(1, np.int64)
    upto = np.append(first, len(place))
    ends = upto[1:] - np.repeat(upto[edge[:-1]], np.diff(edge))
    once = np.add.reduceat(np.diff(upto) > 1, edge[:-1]) == 0 if len(code) else np.zeros(0, bool)
    ends, size = ends[~np.repeat(once, np.diff(edge))], np.where(once, 0, np.diff(edge))
    ended = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), mask=np.append(once, False)), pa.array(ends.astype(np.int32)))
    listed = lambda at, values: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
    return coded.dictionary.take(pa.array(code[edge[:-1]])), listed(edge, ids.take(pa.array(doc))), ended, listed(upto[edge], pa.array(place))


def _ways(words: tuple[str, ...], synonyms: tuple) -> list[tuple[Token, ...]]:
    """The runs of tokens that stand for a word or phrase."""
    def of(word: str) -> list[tuple[Token, ...]]:
        others = [tuple(Token(w, False) for w in a.split()) if " " in a else (Token(a, True),) for t, a in synonyms if t == word]
        return [(Token(word, True),), *others]

    return [tuple(itertools.chain(*parts)) for parts in itertools.product(*map(of, words))]


def _leaves(node: Node) -> list[Node]:
    return [node] if node.words else [x for p in node.parts for x in _leaves(p)]


def _holds_without_words(node: Node) -> bool:
    if node.kind == "not":
        return not _holds_without_words(node.parts[0])
    if node.kind in ("and", "or"):
        return (all if node.kind == "and" else any)(map(_holds_without_words, node.parts))
    return False


def _places(run: tuple[Token, ...], at: dict[Token, Column]) -> Column:
    """Where a run of tokens begins."""
    return reduce(F.array_intersect, (_moved(at[t], i) for i, t in enumerate(run)))


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by) if by else places


def _truth(node: Node, synonyms: tuple, at: dict[Token, Column]) -> Column:
    if node.kind == "not":
        return ~_truth(node.parts[0], synonyms, at)
    if node.kind in ("and", "or"):
        return reduce((lambda a, b: a & b) if node.kind == "and" else (lambda a, b: a | b), (_truth(p, synonyms, at) for p in node.parts))
    return reduce(lambda a, b: a | b, (F.size(_places(run, at)) > 0 for run in _ways(node.words, synonyms)))


def _spans(word: str, at: dict[Token, Column]) -> tuple[Column, Column]:
    """Begins and ends of what stands for a word."""
    runs = _ways((word,), SYNONYMS + BRIDGES)
    begins = [_places(run, at) for run in runs]
    ends = [_moved(b, 1 - len(run)) for b, run in zip(begins, runs, strict=True)]
    return F.concat(*begins), F.concat(*ends)


def _neighbours(a: str, b: str, near: int, at: dict[Token, Column]) -> Column:
    (a_begin, a_end), (b_begin, b_end) = _spans(a, at), _spans(b, at)
    after = lambda ends: F.flatten(F.transform(ends, lambda e: F.sequence(e + 1, e + near)))
    return F.arrays_overlap(after(a_end), b_begin) | F.arrays_overlap(after(b_end), a_begin)


def find(texts: DataFrame, stored: DataFrame, id_col: str, query: str | None, near: int = NEAR) -> DataFrame:
    """The rows of ``texts`` that match loosely, with ``strict`` and ``direct``; none for a blank query.

    ``stored`` are the postings of the same texts; ``texts`` need no text column.
    """
    node = parse(query)
    if node is None:
        return texts.limit(0).withColumns({"strict": F.lit(True), "direct": F.lit(True)})
    tokens = sorted({t for leaf in _leaves(node) for run in _ways(leaf.words, SYNONYMS + BRIDGES) for t in run})
    is_one = lambda t: F.col("term").startswith(t.text) if t.prefix else F.col("term") == t.text
    sought = stored.where(F.col("head").isin(sorted({t.text[0] for t in tokens})) & reduce(lambda a, b: a | b, map(is_one, tokens)))
    plain = node.kind == "and" and all(p.kind == "word" for p in node.parts)
    if all(len(run) == 1 for leaf in _leaves(node) for run in _ways(leaf.words, SYNONYMS + BRIDGES)) and not (plain and near > 0):
        return _join_words(texts, id_col, node, tokens, sought, is_one)
    begin = F.when(F.col("ends").isNull(), F.col("i")).when(F.col("i") > 0, F.get("ends", F.col("i") - 1)).otherwise(0)
    end = F.coalesce(F.get("ends", F.col("i")), F.col("i") + 1)
    texts_of = sought.select("term", "ends", "places", F.posexplode("ids").alias("i", "id")).select("term", "id", F.slice("places", begin + 1, end - begin).alias("places"))
    each = texts_of.select("id", "places", F.explode(F.array_compact(F.array(*(F.when(is_one(t), F.lit(k)) for k, t in enumerate(tokens))))).alias("k"))
    gathered = each.groupBy("id").agg(*(F.array_sort(F.flatten(F.collect_list(F.when(F.col("k") == k, F.col("places"))))).alias(f"p{k}") for k in range(len(tokens))))
    none = F.array().cast("array<int>")
    if _holds_without_words(node):
        ids = texts.select(F.col(id_col).alias("id")).distinct()
        gathered = ids.join(gathered, "id", "left").select("id", *(F.coalesce(f"p{k}", none).alias(f"p{k}") for k in range(len(tokens))))
    at = {t: F.col(f"p{k}") for k, t in enumerate(tokens)}
    loose = _truth(node, SYNONYMS + BRIDGES, at)
    strict = reduce(lambda a, b: a & b, (_neighbours(a.words[0], b.words[0], near, at) for a, b in itertools.pairwise(node.parts))) if plain and near > 0 else loose
    hits = gathered.where(loose).select(F.col("id").alias(id_col), strict.alias("strict"), _truth(node, BRIDGES, at).alias("direct"))
    return texts.join(hits, id_col)


def _join_words(texts: DataFrame, id_col: str, node: Node, tokens: list[Token], sought: DataFrame, is_one: Callable[[Token], Column]) -> DataFrame:
    """``find`` for queries that only ask which words a text has: no places are read."""
    has = [is_one(t).alias(f"p{k}") for k, t in enumerate(tokens)]
    each = sought.select(F.explode("ids").alias("id"), *has)
    gathered = each.groupBy("id").agg(*(F.bool_or(f"p{k}").alias(f"p{k}") for k in range(len(tokens))))
    if _holds_without_words(node):
        ids = texts.select(F.col(id_col).alias("id")).distinct()
        gathered = ids.join(gathered, "id", "left").select("id", *(F.coalesce(f"p{k}", F.lit(False)).alias(f"p{k}") for k in range(len(tokens))))
    at = {t: F.col(f"p{k}") for k, t in enumerate(tokens)}
    loose, direct = _holds(node, SYNONYMS + BRIDGES, at), _holds(node, BRIDGES, at)
    return texts.join(gathered.where(loose).select(F.col("id").alias(id_col), loose.alias("strict"), direct.alias("direct")), id_col)


def _holds(node: Node, synonyms: tuple, at: dict[Token, Column]) -> Column:
    """``_truth`` of a query of single words, where ``at`` says whether a text has them."""
    if node.kind == "not":
        return ~_holds(node.parts[0], synonyms, at)
    if node.kind in ("and", "or"):
        return reduce((lambda a, b: a & b) if node.kind == "and" else (lambda a, b: a | b), (_holds(p, synonyms, at) for p in node.parts))
    return reduce(lambda a, b: a | b, (at[run[0]] for run in _ways(node.words, synonyms)))


def tiered_page(texts: DataFrame, stored: DataFrame, id_col: str, query: str, order: list[Column], page: int = 1, size: int = 20) -> DataFrame:
    """A page of strict matches, direct ones first, then by ``order``; column ``tier``: 1 direct, 0 not."""
    hits = find(texts, stored, id_col, query).where("strict").withColumn("tier", F.col("direct").cast("int"))
    return hits.orderBy(F.desc("tier"), *order).offset((page - 1) * size).limit(size)


def loose_extra(texts: DataFrame, stored: DataFrame, id_col: str, query: str, cap: int = 10_000) -> DataFrame:
    """How many more rows match when the words may stand far apart; both counts are capped."""
    sums = find(texts, stored, id_col, query).agg(F.count_if("strict").alias("s"), F.count("*").alias("l"))
    return sums.select((F.least("l", F.lit(cap)) - F.least("s", F.lit(cap))).alias("extra"))


def trigram_postings(names: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """(bucket, tri, id, n), n being the number of the name's trigrams; to be stored by ``bucket``."""
    rows = names.select(F.col(id_col).alias("id"), trigrams(F.col(name_col)).alias("t"))
    rows = rows.select("id", F.size("t").alias("n"), F.explode("t").alias("tri")).withColumn("bucket", _bucket(F.col("tri")))
    return rows.repartitionByRange("bucket", "tri", "id").sortWithinPartitions("bucket", "tri", "id")


def _bucket(tri: Column) -> Column:
    return F.pmod(F.xxhash64(tri), F.lit(_BUCKETS)).cast("int")


def trigrams_of(text: str) -> list[str]:
    padded = [f"  {w} " for w in re.findall(r"[^\W_]+", text.lower())]
    return list(dict.fromkeys(w[i : i + 3] for w in padded for i in range(len(w) - 2)))


def _with_trigrams(stored: DataFrame, wanted: list[str]) -> DataFrame:
    """The postings of some trigrams, out of their folders only."""
    buckets = stored.sparkSession.range(1).select(F.array(*(_bucket(F.lit(t)) for t in wanted)).alias("b")).first().b
    return stored.where(F.col("bucket").isin(sorted(set(buckets))) & F.col("tri").isin(wanted))


def rarest_first(stored: DataFrame, wanted: list[str]) -> list[str]:
    """Some trigrams by how many names have them; those that none has come first."""
    counts = {r.tri: r["count"] for r in _with_trigrams(stored, wanted).groupBy("tri").count().collect()}
    return sorted(wanted, key=lambda t: (counts.get(t, 0), t))


def candidates(stored: DataFrame, query: str, least: float) -> DataFrame:
    """(id) of names that may be similar to the query by more than ``least``: with one of its rarest trigrams
    and a fitting number of trigrams. A name that is similar enough shares more than ``least`` of the
    query's q trigrams, so it cannot lack all of any q - that number + 1."""
    wanted = trigrams_of(query)
    q = len(wanted)
    kept = rarest_first(stored, wanted)[: q - int(least * q)] if wanted else []
    return _with_trigrams(stored, kept).where((F.col("n") > least * q) & (F.col("n") * least < q)).select("id").distinct() if kept else stored.select("id").limit(0)


def similar(stored: DataFrame, query: str, least: float = 0.3) -> DataFrame:
    """(id, similarity) of the names whose trigrams in common over trigrams in either are over ``least``."""
    wanted = trigrams_of(query)
    if not wanted:
        return stored.select("id", F.lit(0.0).alias("similarity")).limit(0)
    shared = _with_trigrams(stored, wanted).join(candidates(stored, query, least), "id", "left_semi").groupBy("id", "n").agg(F.count("*").alias("o"))
    return shared.select("id", (F.col("o") / (F.lit(len(wanted)) + F.col("n") - F.col("o"))).alias("similarity")).where(F.col("similarity") > least)


def suggest(names: DataFrame, stored: DataFrame, id_col: str, query: str, order: list[Column], least: float = 0.3) -> DataFrame:
    """The most similar name, if over ``least``; none for queries below three letters."""
    q = fold_text(query).strip()
    found = similar(stored, q, least).withColumnRenamed("id", id_col)
    rows = names.join(found, id_col) if len(q) >= 3 else names.limit(0).withColumn("similarity", F.lit(0.0))
    return rows.orderBy(F.desc("similarity"), *order).limit(1)


def entity_search(names: DataFrame, stored: DataFrame, id_col: str, name_col: str, count_col: str, query: str, limit: int = 8, least: int = 2) -> DataFrame:
    """Names that hold the query or resemble it: prefix first, then inner matches, then by count and name.

    A name that holds the query has all three-letter windows of its words; names with the rarest
    of them are looked at. Queries without such a window are looked for in all names.
    """
    q = fold_text(query).strip()
    n = F.col(name_col)
    rows = names.where((F.col(count_col) >= least) & F.lit(len(q) >= 2))
    near = similar(stored, q).select(F.col("id").alias(id_col))
    inner = [w[i : i + 3] for w in re.findall(r"[^\W_]+", q.lower()) for i in range(len(w) - 2)]
    if inner:
        held = _with_trigrams(stored, rarest_first(stored, inner)[:1]).select(F.col("id").alias(id_col))
        rows = rows.join(held.unionByName(near).distinct(), id_col, "left_semi")
    found = rows.where(n.contains(q)).unionByName(rows.join(near, id_col, "left_semi").where(~n.contains(q)))
    return found.orderBy(n.startswith(q).desc(), n.contains(q).desc(), F.desc(count_col), n).limit(limit)

"""Personal data: fixed patterns, and names and addresses found by a random field.

Patterns give the base spans of e-mail addresses, IP addresses, card and phone
numbers. A linear-chain conditional random field over word-shape features,
trained from a small labelled table, adds names and postal addresses where they
overlap no base span. Spans count code points, end exclusive.

Each pattern is read in time linear in the text: an e-mail address is looked for
from its ``@`` outwards, and digit runs are entered at their first digit only,
which finds the same leftmost matches.

The field finds what looks like a Western name or street address in running text; its
measured precision and recall are in the README.

Defined results: null and empty texts have no spans; a very long text is read whole, in
time linear in its length, by the task that holds it; repeated rows stay; input columns
named like an output column are replaced; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.llm import bytewords as bw
from tabulary.llm import crf, pii_table
from tabulary.llm.arrowmap import add_columns

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "name", "address")
_SLICE = 1 << 20
_KIND = np.array([KINDS.index(x[2:]) if x != "O" else 0 for x in crf.LABELS])
_INNER = np.array([x[0] == "I" for x in crf.LABELS])

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > floor and _LOCAL.match(text, start - 1):
            start -= 1
        hit = _DOMAIN.match(text, at + 1) if start < at else None
        if hit:
            yield start, hit.end()
            floor = hit.end()
        else:
            floor = at + 1
        at = text.find("@", floor)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern matches that hold, by kind as listed, then by start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if re.search("[0-9]", text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                d = _DIGITS.sub("", m[0])
                if 13 <= len(d) <= 19 and _luhn(d):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m[0])) <= 15]
    return out


@cache
def _own_model() -> crf.Model:
    return crf.train(pii_table.labelled_table(), crf.Lexicon(*pii_table.lexicon(), pii_table.TITLES))


def trained(table: list[tuple[list[str], list[str]]] | None = None) -> crf.Model:
    """The field fitted on ``table`` (tokens, labels of each sentence), or on ``pii_table``'s; fitting is deterministic."""
    return crf.train(table, crf.Lexicon(*pii_table.lexicon(), pii_table.TITLES)) if table else _own_model()


def _field_spans(model: crf.Model, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[str, int, int]]]:
    """Names and addresses of a slice's texts, by row and in order; spans count code points. One that
    begins with the word it ends with, as repeated words do, is none."""
    t = crf.tokens(data, offsets, model.lexicon)
    label = model.decode(t)
    hot = np.flatnonzero(label)
    if not len(hot):
        return {}
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    doc = np.searchsorted(t.words.first, hot, side="right") - 1
    begin, end = points[t.start[hot]] - points[offsets[doc]], points[t.end[hot]] - points[offsets[doc]]
    kind, inner = _KIND[label[hot]], _INNER[label[hot]]
    edge = np.zeros(len(t.shape) + 1, bool)
    edge[t.first] = True
    joins = np.zeros(len(hot), bool)
    joins[1:] = inner[1:] & ~edge[hot[1:]] & (hot[1:] == hot[:-1] + 1) & (kind[1:] == kind[:-1])
    head = np.flatnonzero(~joins)
    last = np.append(head[1:], len(hot)) - 1
    out: dict[int, list[tuple[str, int, int]]] = {}
    ends = zip(hot[head].tolist(), hot[last].tolist(), strict=True)
    for d, k, a, b, (x, y) in zip(doc[head].tolist(), kind[head].tolist(), begin[head].tolist(), end[last].tolist(), ends, strict=True):
        same = x != y and data[t.start[x] : t.end[x]].tobytes() == data[t.start[y] : t.end[y]].tobytes()
        if _leads(data, t.start[x]) and _leads(data, t.start[y]) and not same:
            out.setdefault(d, []).append((KINDS[k], a, b))
    return out


def _leads(data: np.ndarray, at: int) -> bool:
    """Whether a word may begin or end a name or address: with a capital or a digit; runs of articles and particles do not."""
    first = data[at : at + 4].tobytes().decode("utf-8", "ignore")[:1]
    return first.isupper() or first.isdigit()


def _outside(base: list[tuple[str, int, int]], more: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Those of ``more`` (sorted, disjoint) that overlap no span of ``base``: one sweep over both."""
    taken = sorted((a, b) for _, a, b in base)
    out, k, reach = [], 0, 0
    for kind, a, b in more:
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= a:
            out.append((kind, a, b))
    return out


def all_spans(model: crf.Model, column: pa.Array) -> list[list[tuple[str, int, int]]]:
    """Spans of each text by kind as listed, then by start; code points."""
    out = []
    for lo, hi, data, offsets in bw.slices(column, _SLICE):
        added = _field_spans(model, data, offsets)
        for k, text in enumerate(column.slice(lo, hi - lo).to_pylist()):
            spans = base_spans(text) if text else []
            if k in added:
                spans += sorted(_outside(spans, added[k]), key=lambda m: (KINDS.index(m[0]), m[1]))
            out.append(spans)
    return out


_SPANS = "array<struct<kind:string,begin:int,end:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))


def find_pii(df: DataFrame, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``spans``: kind, begin and end of all personal data in each text."""
    model = df.sparkSession.sparkContext.broadcast(trained())

    def make(batch: pa.RecordBatch) -> dict:
        found = all_spans(model.value, batch.column(batch.schema.get_field_index(text_col)))
        return {"spans": pa.array([[dict(zip(("kind", "begin", "end"), s, strict=True)) for s in x] for x in found], _ARROW)}

    return add_columns(df, f"spans {_SPANS}", make, drop=drop)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each stretch covered by spans replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with personal data in ``text_col`` replaced; null texts stay null."""
    model = df.sparkSession.sparkContext.broadcast(trained())

    def make(batch: pa.RecordBatch) -> dict:
        column = batch.column(batch.schema.get_field_index(text_col))
        found = all_spans(model.value, column)
        return {text_col: pa.array([masked(t, s) if s else t for t, s in zip(column.to_pylist(), found, strict=True)], pa.string())}

    return add_columns(df, f"{text_col} string", make).select(df.columns)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), drop=("text",))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def mask_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data masked, n_chars counted again."""
    return mask_pii(docs).withColumn("n_chars", F.length("text").cast("long"))

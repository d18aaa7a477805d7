"""SentencePiece encoding that keeps, for every piece, its bytes in the original text.

The text is normalised here: at each position a symbol that the user has defined is
taken as it stands, or else the longest prefix that the model's compiled character map
knows is replaced (one character is copied where it knows none); spaces are treated as
the model says, and every normalised byte records the original byte that it came from.

What is encoded is this normalised text: the library gets the model's vocabulary with
its own normalisation switched off and merges the pieces. Their widths must add up to
the normalised text, and each piece's span is the stretch of original bytes that its
normalised bytes came from.

Defined results: null and empty texts have no ids and no spans and decode to an
empty text; a very long text is encoded whole, by the task that holds it; repeated rows
stay; an empty table gives none. Ids outside the vocabulary are an error of the
library. Input columns named like an output column are replaced.
"""

from __future__ import annotations

import struct
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tabulary.llm.arrowmap import add_columns

MODEL = "piece_bpe_32k.model"
#: Bytes of a table that a worker holds at once.
PIECE_BYTES = 1 << 20
_MARK = "▁"


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 and its replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, bytes replaced) of the longest known prefix of data[at:], if any."""
        if not self.units:
            return None
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (units[node] & 0x7FFFFFFF, k + 1 - at)
        if found is None:
            return None
        start = found[0]
        return self.texts[start : self.texts.index(b"\0", start)], found[1]


class Normaliser:
    """A model's normalisation: its character map, its defined symbols and its treatment of spaces."""

    def __init__(self, spec, symbols: tuple[bytes, ...] = (), suffix: bool = False):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.symbols: dict[int, list[bytes]] = {}
        for x in sorted(symbols, key=len, reverse=True):
            self.symbols.setdefault(x[0], []).append(x)
        self.prefix, self.suffix = spec.add_dummy_prefix and not suffix, spec.add_dummy_prefix and suffix
        self.squeeze = spec.remove_extra_whitespaces
        self.mark = _MARK.encode() if spec.escape_whitespaces else b" "
        self.plain = not self.map.units and not self.squeeze

    def align(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and the end the original offset."""
        if not data:
            return b"", np.zeros(1, np.int64)
        return self._align_plain(data) if self.plain else self._align_mapped(data)

    def _align_plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        raw = np.frombuffer(data, np.uint8)
        origin = np.repeat(np.arange(len(raw)), np.where(raw == 32, len(self.mark), 1))
        head, tail = self.mark * self.prefix, self.mark * self.suffix
        return head + data.replace(b" ", self.mark) + tail, np.concatenate([np.zeros(len(head), np.int64), origin, np.full(len(tail) + 1, len(raw))])

    def _step(self, data: bytes, at: int) -> tuple[bytes, int]:
        """What stands for the text at ``at``, and how many bytes it takes."""
        for x in self.symbols.get(data[at], ()):
            if data.startswith(x, at):
                return x, len(x)
        if hit := self.map.longest(data, at):
            return hit
        n = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
        return data[at : at + n], n

    def _align_mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        steps, at = [], 0
        while at < len(data):
            text, n = self._step(data, at)
            steps.append((text, at, n))
            at += n
        if self.squeeze:
            head = next((k for k, step in enumerate(steps) if step[0] != b" "), None)
            if head is None:
                return b"", np.array([len(data)])
            steps = steps[head:]
        out, origin = bytearray(), []
        if self.prefix:
            out += self.mark
            origin += [steps[0][1]] * len(self.mark)
        spaced, end = self.squeeze, steps[0][1]
        for text, start, n in steps:
            while spaced and text.startswith(b" "):
                text = text[1:]
            for b in text:
                piece = self.mark if b == 32 else bytes([b])
                out += piece
                origin += [start] * len(piece)
            if text:
                spaced = self.squeeze and text.endswith(b" ")
            end = start + n
        if self.squeeze:
            while out.endswith(self.mark):
                del out[-len(self.mark) :]
                end = origin[-len(self.mark)]
                del origin[-len(self.mark) :]
        if self.suffix:
            out += self.mark
            origin += [end] * len(self.mark)
        return bytes(out), np.array([*origin, end])


class Encoder:
    """A model's vocabulary behind our own normalisation; ``model`` is the serialised model."""

    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        symbols = tuple(p.piece.encode() for p in proto.pieces if p.type == kinds.USER_DEFINED)
        self.normaliser = Normaliser(proto.normalizer_spec, symbols, proto.trainer_spec.treat_whitespace_as_suffix)
        self.width = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in proto.pieces])
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.reader = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = proto.normalizer_spec
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = b"", False, False, False
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """Ids, span begins and span ends (original bytes) of each text."""
        aligned = [self.normaliser.align((t or "").encode()) for t in texts]
        ids = [np.array(x, np.int32) for x in self.merger.encode([x for x, _ in aligned], num_threads=1)]
        begins, ends = [], []
        for k, (text, origin) in enumerate(aligned):
            width = self.width[ids[k]]
            if (ids[k] == self.unknown).any():
                width = np.array([len(p.surface.encode()) for p in self.merger.encode(text.decode(), return_type="proto").pieces])
            edge = np.concatenate([[0], np.cumsum(width)])
            if edge[-1] != len(text):
                raise ValueError("pieces and normalised text differ in length")
            begins.append(origin[edge[:-1]].astype(np.int32))
            ends.append(origin[edge[1:]].astype(np.int32))
        return ids, begins, ends

    def decode(self, ids: list[int] | None) -> str:
        return self.reader.decode(ids) if ids else ""


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(Path(path).read_bytes())


def vocabulary_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*arrays, np.zeros(0, np.int32)]), pa.int32()))


def encode(df: DataFrame, text_col: str = "text", path: str | None = None, drop: tuple[str, ...] = (), and_decode: bool = False) -> DataFrame:
    """``df`` with ids, begins and ends: piece ids, and their spans in the text's UTF-8 bytes.

    ``and_decode`` adds ``decoded``, as ``decode`` would. ``path`` names the model
    file, at the same place on every executor; null: the public vocabulary's place there.
    """

    def make(batch: pa.RecordBatch) -> dict:
        e = encoder(path or vocabulary_path())
        found = e.encode(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
        out = dict(zip(("ids", "begins", "ends"), map(_lists, found), strict=True))
        return out | ({"decoded": pa.array([e.decode(i.tolist()) for i in found[0]], pa.string())} if and_decode else {})

    ddl = "ids array<int>, begins array<int>, ends array<int>" + (", decoded string" if and_decode else "")
    return add_columns(df, ddl, make, drop=drop, piece=PIECE_BYTES)


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``decoded``, the text of its piece ids; null ids give an empty text."""

    def make(batch: pa.RecordBatch) -> dict:
        e = encoder(path or vocabulary_path())
        return {"decoded": pa.array([e.decode(i) for i in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()], pa.string())}

    return add_columns(df, "decoded string", make, drop=drop, piece=PIECE_BYTES)


def _digest(docs: DataFrame) -> DataFrame:
    found = encode(docs.select("doc_id", "text"), drop=("text",), and_decode=True)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).alias("span_end"),
    )


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: piece counts and digests of what is left of each document."""
    return _digest(docs)

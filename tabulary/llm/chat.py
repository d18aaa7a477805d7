r"""Chat formatting: schema fingerprints choose how a raw record becomes turns.

A record is a JSON text, or a struct with some of the fields of ``RECORD``. Its layout is
found by a fingerprint: the hash of those of its nested field paths that any mapping
reads, values and array lengths left out. ``LAYOUTS`` declares for each layout where its
turns are; the hash of the paths that it reads selects its mapping, so other keys (ids, names,
sources) never stand in the way. ``fingerprint`` itself hashes all paths; records of no layout have
a null ``layout`` and null ``turns`` and can be counted by it; no record is dropped.
A path is there if it has a value or, at the top of a JSON text, a key.

JSON texts are read without the parser's usual limit on strings. Beyond 128 MiB
``fingerprint`` is null (no variant holds such a record); layout and turns do not need it.

The template writes a turn as ``<|im_start|>role\ntext<|im_end|>\n``. Control
strings inside roles and texts (those of this template and of other common
ones) get a backslash after their first character, and one more where some
stand there already; reading takes one away. So a text can never end a turn, and
every text comes back unchanged. In roles, backslash and newline are written as
``\\`` and ``\n``.

Everything is DataFrame work. A conversation is gathered only for its output,
which is one string. Defined results: null texts and roles count as empty; rows
that repeat a turn number are ordered by role, then text; repeated rows are
turns of their own; a null conv_id is a conversation of its own; very long texts come back
whole, up to what one string of the output can hold; an empty table gives only what is added
to it. Only the named columns of conversations are read; in records, columns named like an
output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Control strings of this and other templates: first character, then the rest.
_CONTROL = [("<", r"\|im_start\|>"), ("<", r"\|im_end\|>"), ("<", r"\|endoftext\|>"), ("<", r"/?s>"), (r"\[", r"/?INST\]"), ("<", r"</?SYS>>")]
_ESCAPE = "(?:" + "|".join(f"(?<={a})(?={chr(92) * 2}*{b})" for a, b in _CONTROL) + ")"
_UNESCAPE = "(?:" + "|".join(rf"(?<={a}){chr(92) * 2}(?={chr(92) * 2}*{b})" for a, b in _CONTROL) + ")"

#: Where the turns of a layout are, in parts: ("each", array, role, text), or
#: ("one", role, fields whose texts are joined by a blank line).
LAYOUTS = [
    ("messages", [("each", "messages", "role", "content")]),
    ("system_messages", [("one", "system", ["system"]), ("each", "messages", "role", "content")]),
    ("conversations", [("each", "conversations", "from", "value")]),
    ("turns", [("each", "turns", "role", "text")]),
    ("dialog", [("each", "dialog.turns", "speaker", "utterance")]),
    ("instruction", [("one", "user", ["instruction", "input"]), ("one", "assistant", ["output"])]),
    ("instruction_only", [("one", "user", ["instruction"]), ("one", "assistant", ["output"])]),
    ("instruction_response", [("one", "user", ["instruction"]), ("one", "assistant", ["response"])]),
    ("prompt", [("one", "user", ["prompt"]), ("one", "assistant", ["completion"])]),
    ("prompt_response", [("one", "user", ["prompt"]), ("one", "assistant", ["response"])]),
    ("system_prompt", [("one", "system", ["system"]), ("one", "user", ["prompt"]), ("one", "assistant", ["response"])]),
    ("question", [("one", "user", ["question"]), ("one", "assistant", ["answer"])]),
]
#: Roles that layouts call otherwise.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant"}


def _paths(schema: Column) -> Column:
    """Field paths of a variant's schema text: its structure without the types of leaves."""
    leaf = r"(?<=[:<,] ?)(VOID|STRING|BIGINT|BOOLEAN|DOUBLE|FLOAT|DATE|TIMESTAMP(_NTZ)?|BINARY|VARIANT|UUID|DECIMAL\([0-9]+,[0-9]+\))"
    return F.regexp_replace(schema, leaf, "*")


#: No bound on one string; Spark's own default is 20,000,000 characters.
_JSON = {"maxStringLen": str((1 << 31) - 1)}


def fingerprint(record: Column) -> Column:
    """Hash of all nested field paths of a JSON text; null where it is no JSON."""
    paths = _paths(F.schema_of_variant(F.from_json(record, T.VariantType(), _JSON)))
    return F.when(paths.isNotNull(), F.xxhash64(paths))


def _reads(parts: list) -> list[str]:
    """The sorted paths that a layout's mapping reads."""
    each = [f"{p[1]}[].{field}" for p in parts if p[0] == "each" for field in p[2:]]
    return sorted([*each, *(field for p in parts if p[0] == "one" for field in p[2])])


def _schema() -> T.StructType:
    """A struct of all fields that some mapping reads."""
    made: dict = {}
    for _, parts in LAYOUTS:
        for path in _reads(parts):
            at = made
            for step in path.split(".")[:-1]:
                at = at.setdefault(step, {})
            at[path.split(".")[-1]] = None

    def struct(fields: dict) -> T.StructType:
        kinds = {n.removesuffix("[]"): T.StringType() if f is None else T.ArrayType(struct(f)) if n.endswith("[]") else struct(f) for n, f in fields.items()}
        return T.StructType([T.StructField(n, k) for n, k in kinds.items()])

    return struct(made)


RECORD = _schema()


def _has(record: Column, path: str) -> Column:
    if "[]" not in path:
        return record[path].isNotNull()
    array, field = path.split("[].")
    return F.coalesce(F.exists(_at(record, array), lambda x: x[field].isNotNull()), F.lit(False))


def _at(record: Column, path: str) -> Column:
    for step in path.split("."):
        record = record[step]
    return record


def layout_print(record: Column, keys: Column | None = None) -> Column:
    """Hash of the paths of a ``RECORD`` that mappings read; ``keys`` are present whatever their values."""
    known = sorted({path for _, parts in LAYOUTS for path in _reads(parts)})
    there = [_has(record, p) if keys is None or "[]" in p else _has(record, p) | F.coalesce(F.array_contains(keys, p), F.lit(False)) for p in known]
    return F.xxhash64(F.array_join(F.array(*(F.when(t, F.lit(p)) for t, p in zip(there, known, strict=True))), ","))


def _each(record: Column, array: str, role: str, text: str) -> Column:
    return F.transform(_at(record, array), lambda x: F.struct(F.coalesce(x[role], F.lit("")).alias("role"), F.coalesce(x[text], F.lit("")).alias("text")))


def _one(record: Column, role: str, fields: list[str]) -> Column:
    texts = F.filter(F.array(*(record[field] for field in fields)), lambda x: x != "")
    return F.array(F.struct(F.lit(role).alias("role"), F.array_join(texts, "\n\n").alias("text")))


def _turns(record: Column, parts: list) -> Column:
    made = [(_each if kind == "each" else _one)(record, *where) for kind, *where in parts]
    return made[0] if len(made) == 1 else F.concat(*made)


def _with_own_roles(turns: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.transform(turns, lambda t: F.struct(F.coalesce(names[t["role"]], t["role"]).alias("role"), t["text"].alias("text")))


def _mapped(rows: DataFrame) -> DataFrame:
    """``rows`` with layout and turns, from __record and __print."""
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout, parts in LAYOUTS:
        hit = F.col("__print") == F.xxhash64(F.lit(",".join(_reads(parts))))
        name = F.when(hit, F.lit(layout)).otherwise(name)
        turns = F.when(hit, _turns(F.col("__record"), parts)).otherwise(turns)
    return rows.withColumn("layout", name).withColumn("turns", _with_own_roles(turns)).drop("__record", "__print")


def canonical_turns(records: DataFrame, record_col: str = "record") -> DataFrame:
    """``records`` with fingerprint, layout and turns: array<struct<role, text>>, from JSON texts.

    Input columns named like an output column are replaced.
    """
    record = F.col(record_col)
    rows = records.withColumn("__record", F.from_json(record, RECORD, _JSON))
    rows = rows.withColumn("__print", layout_print(F.col("__record"), F.json_object_keys(record))).withColumn("fingerprint", fingerprint(record))
    return _mapped(rows)


def structured_turns(records: DataFrame, **fields: Column) -> DataFrame:
    """``records`` with fingerprint, layout and turns, from columns that stand for fields of ``RECORD``."""
    blank = {f.name: F.lit(None).cast(f.dataType) for f in RECORD}
    unknown = set(fields) - set(blank)
    if unknown:
        raise ValueError(f"no layout reads {sorted(unknown)}")
    whole = F.struct(*(c.cast(RECORD[n].dataType).alias(n) for n, c in (blank | fields).items()))
    rows = records.withColumn("__record", whole)
    rows = rows.withColumn("__print", layout_print(F.col("__record"))).withColumn("fingerprint", F.col("__print"))
    return _mapped(rows)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "")


def _write_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _read_role(role: Column) -> Column:
    plain = F.replace(F.replace(F.replace(role, F.lit("\\\\"), F.lit("\\\0")), F.lit("\\n"), F.lit("\n")), F.lit("\\\0"), F.lit("\\"))
    return unescape(plain)


def format_turns(turns: Column) -> Column:
    """One string that holds all turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(BEGIN), _write_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(f"{END}\n"))), "")


def read_segments(formatted: Column) -> Column:
    """array<struct<role, body, head, size>> of a formatted string: the escaped text of each
    turn, the code points before it in its turn, and those of the whole turn."""
    parts = F.filter(F.split(formatted, r"(?<=<\|im_end\|>\n)(?=<\|im_start\|>)"), lambda x: x != "")
    tail = len(END) + 1

    def one(x: Column) -> Column:
        role = F.substring_index(x.substr(F.lit(len(BEGIN) + 1), F.length(x)), "\n", 1)
        head = F.length(role) + len(BEGIN) + 1
        body = x.substr(head + 1, F.length(x) - head - tail)
        return F.struct(_read_role(role).alias("role"), body.alias("body"), head.alias("head"), F.length(x).alias("size"))

    return F.transform(parts, one)


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums_before(sizes: Column) -> Column:
    """For each element the sum of those before it, over blocks of about the square root of their number."""
    add = lambda a, x: a + x
    zero = F.lit(0).cast("long")
    n = F.size(sizes)
    width = F.ceil(F.sqrt(n)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1), lambda b: F.aggregate(F.slice(sizes, b * width + 1, width), zero, add))
    before = lambda firsts: F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.get(firsts, F.floor(i / width).cast("int")) + F.aggregate(F.slice(sizes, i - i % width + 1, i % width), zero, add))
    firsts = F.aggregate(blocks, F.array(zero), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(_let(firsts, before))


def add_loss_mask(df: DataFrame, formatted_col: str = "formatted") -> DataFrame:
    """``df`` with segments (role, escaped body, head, size, begin of the body), as read back from the
    output, and loss_spans (role, begin, end, segment): the code points of the assistant texts, in order."""
    d = df.withColumn("segments", read_segments(F.col(formatted_col)))
    sizes = F.transform("segments", lambda s: s["size"].cast("long"))
    placed = lambda at: F.transform("segments", lambda s, i: s.withField("begin", F.get(at, i) + s["head"]))
    d = d.withColumn("segments", _let(_let(sizes, _sums_before), placed))
    spans = F.transform("segments", lambda s, i: F.struct(
        s["role"].alias("role"), s["begin"].alias("begin"), (s["begin"] + s["size"] - s["head"] - len(END) - 1).alias("end"), i.alias("segment")))
    return d.withColumn("loss_spans", F.filter(spans, lambda s: s["role"] == "assistant"))


def text_under_mask(segments: Column, spans: Column) -> Column:
    """The text of the spans, unescaped, nothing between. A span is cut out of its own segment, so
    the whole string is never searched from its start for each of them."""

    def cut(s: Column) -> Column:
        g = F.get(segments, s["segment"])
        return unescape(g["body"].substr((s["begin"] - g["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))

    return F.array_join(F.transform(spans, cut), "")


def gather(conversations: DataFrame) -> DataFrame:
    """(conv_id, fingerprint, layout, turns) per conversation, from rows (conv_id, turn, role, text).

    The rows of a conversation become a record in the layout "turns", as structs: they never
    pass through JSON.
    """
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("__rows"))
    record = F.transform("__rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return structured_turns(rows, turns=record).drop("__rows")


def with_format(turns: DataFrame) -> DataFrame:
    return turns.withColumn("formatted", format_turns(F.col("turns")))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, fingerprint, layout, turns, formatted) of each conversation."""
    return with_format(gather(conversations))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's conversations are records of rows, the added one is a record of another layout."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    added = spark.range(1).select(F.lit(-1).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.to_json(F.struct(F.lit(trap).alias("prompt"), F.lit(trap).alias("completion"))).alias("record"))
    turns = gather(rows).unionByName(canonical_turns(added).drop("record"))
    found = add_loss_mask(with_format(turns))
    texts = F.transform("segments", lambda s: F.concat(s["role"], F.lit("\n"), unescape(s["body"]), F.lit("\n")))
    return found.withColumn("__loss", text_under_mask(F.col("segments"), F.col("loss_spans"))).select(
        "conv_id", F.size("segments").cast("long").alias("n_turns"), F.sha2(F.array_join(texts, ""), 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"), F.sha2("__loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "layout",
    )


OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), made AS (
  SELECT conv_id, turn, role, text,
    regexp_replace(text, '([<\[])(\\*(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>))', '\1\\\2', 'g') AS body
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(body) + 24)::BIGINT AS formatted_chars,
  CASE WHEN conv_id = -1 THEN 'prompt' ELSE 'turns' END AS layout
FROM made GROUP BY conv_id
"""

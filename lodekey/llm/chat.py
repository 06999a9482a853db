"""Chat formatting with DataFrame functions only.

Layouts differ: one row per turn, an array of messages, prompt and response
columns, or instruction, input and output columns.  The nested field paths
of a schema are hashed, and the hash selects a declarative mapping that
yields canonical turns ``(conv_id, turn, role, text)``.  Where a schema has
fields of several layouts, the first of ``MAPPINGS`` whose paths it all has,
by the hash of those paths, is chosen.  JSON records of mixed layouts are
fingerprinted row by row in the same way.

The template writes each turn as ``START role SEP text END``.  Wherever a
role or text holds a control string, a backslash follows that string's first
character, and a backslash of the text is doubled; unescaping drops one
backslash before any character, so texts come back exactly.

Defined results: null role or text is empty; ties in ``turn`` are ordered by
role, then text; repeated rows are turns of their own; null turn sorts
first; a null ``conv_id`` is a conversation; extra columns are ignored, also
those of layouts lower in ``MAPPINGS``; roles of turn rows stay as they are,
those of messages get their common names; an empty table gives no rows.  One conversation is one output row, so its turns
meet in one task: memory grows with the longest conversation only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROLS = (START, SEP, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"

_CONTROL_AHEAD = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROLS)


# --------------------------------------------------------------- fingerprints


def field_paths(schema: T.DataType, prefix: str = "") -> Iterator[str]:
    """Paths of all leaves; ``[]`` marks the elements of an array."""
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            yield from field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)
    elif isinstance(schema, T.ArrayType):
        yield from field_paths(schema.elementType, f"{prefix}[]")
    else:
        yield prefix


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    ``messages`` names an array of structs with ``role`` and ``text`` fields;
    ``turns`` lists (fixed role, field, fields joined below it) per record;
    with neither, each row is a turn and ``role``, ``text``, ``order`` name
    its columns.
    """

    name: str
    paths: tuple[str, ...]
    messages: str | None = None
    role: str = "role"
    text: str = "text"
    order: str | None = None
    turns: tuple[tuple[str, str, tuple[str, ...]], ...] = ()


#: In order of precedence; of two of which one has more fields, that comes first.
MAPPINGS = (
    Mapping("turn_rows", ("role", "text", "turn"), order="turn"),
    Mapping("messages_content", ("messages[].content", "messages[].role"), messages="messages", text="content"),
    Mapping("messages_text", ("messages[].role", "messages[].text"), messages="messages"),
    Mapping("conversations_value", ("conversations[].from", "conversations[].value"), messages="conversations", role="from", text="value"),
    Mapping("system_prompt_response", ("prompt", "response", "system"), turns=(("system", "system", ()), ("user", "prompt", ()), ("assistant", "response", ()))),
    Mapping("prompt_response", ("prompt", "response"), turns=(("user", "prompt", ()), ("assistant", "response", ()))),
    Mapping("prompt_completion", ("completion", "prompt"), turns=(("user", "prompt", ()), ("assistant", "completion", ()))),
    Mapping("instruction_input_output", ("input", "instruction", "output"), turns=(("user", "instruction", ("input",)), ("assistant", "output", ()))),
    Mapping("instruction_output", ("instruction", "output"), turns=(("user", "instruction", ()), ("assistant", "output", ()))),
)
KNOWN_PATHS = frozenset(p for m in MAPPINGS for p in m.paths)
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def select_mapping(schema: T.StructType) -> Mapping:
    """The first mapping whose paths a schema has; other fields don't count."""
    paths = set(field_paths(schema))
    found = next((m for m in MAPPINGS if fingerprint(paths & set(m.paths)) == fingerprint(m.paths)), None)
    if found is None:
        raise ValueError(f"no layout has only the fields {sorted(paths & KNOWN_PATHS)}")
    return found


def _role(c: Column) -> Column:
    c = F.coalesce(c.cast("string"), F.lit(""))
    names = F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv])
    return F.coalesce(names[c], c)


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _record_turns(m: Mapping, get) -> Column:
    """An array of (role, text) from one record; ``get`` finds a field."""
    if m.messages:
        return F.coalesce(
            F.transform(get(m.messages), lambda x: F.struct(_role(x[m.role]).alias("role"), _text(x[m.text]).alias("text"))),
            F.array().cast("array<struct<role:string,text:string>>"),
        )
    return F.array(*[
        F.struct(
            F.lit(role).alias("role"),
            F.concat_ws("\n", *[F.when(_text(get(x)) != "", _text(get(x))) for x in (field, *more)]).alias("text"),
        )
        for role, field, more in m.turns
    ])


def canonical_turns(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Turns of a table whose schema fingerprint is known."""
    m = select_mapping(df.schema)
    if not m.messages and not m.turns:
        return df.select(F.col(conv_id).alias("conv_id"), F.col(m.order).cast("long").alias("turn"), _text(F.col(m.role)).alias("role"), _text(F.col(m.text)).alias("text"))
    return df.select(F.col(conv_id).alias("conv_id"), F.posexplode(_record_turns(m, F.col)).alias("turn", "t")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.col("t.role").alias("role"), F.col("t.text").alias("text")
    )


_TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def _json_turns(df: DataFrame, record: str, conv_id: str) -> DataFrame:
    """``conv_id``, ``record`` and its turns; null where no mapping fits."""
    names = sorted({p.split("[")[0].split(".")[0] for p in KNOWN_PATHS})
    parsed = F.from_json(F.col(record).cast("string"), T.MapType(T.StringType(), T.StringType()))
    rows = df.select(F.col(conv_id).alias("conv_id"), F.col(record).alias("record"), parsed.alias("m"))
    inner = T.ArrayType(T.MapType(T.StringType(), T.StringType()))
    lists = sorted({m.messages for m in MAPPINGS if m.messages})
    rows = rows.select("conv_id", "record", "m", *[F.from_json(F.col("m")[x], inner).alias(f"l_{x}") for x in lists])

    def below(x: str) -> Column:
        keys = F.flatten(F.transform(F.coalesce(F.col(f"l_{x}"), F.array().cast(inner)), lambda m: F.map_keys(m)))
        return F.transform(F.array_distinct(keys), lambda k: F.concat(F.lit(f"{x}[]."), k))

    flat = F.filter(F.map_keys("m"), lambda k: k.isin([n for n in names if n not in lists]))
    rows = rows.withColumn("paths", F.concat(flat, *[below(x) for x in lists]))
    turns = F.lit(None).cast(_TURNS)
    for m in reversed(MAPPINGS):
        mine = F.array_sort(F.array_distinct(F.array_intersect("paths", F.array(*map(F.lit, m.paths)))))
        if m.messages or m.turns:
            made = _record_turns(m, (lambda f: F.col(f"l_{f}")) if m.messages else (lambda f: F.col("m")[f]))
            made = F.transform(made, lambda t, i: F.struct(i.cast("bigint").alias("turn"), t["role"].alias("role"), t["text"].alias("text")))
        else:
            made = F.array(F.struct(F.col("m")[m.order].cast("bigint").alias("turn"), _text(F.col("m")[m.role]).alias("role"), _text(F.col("m")[m.text]).alias("text")))
        turns = F.when(F.sha2(F.array_join(mine, "\n"), 256) == fingerprint(m.paths), made).otherwise(turns)
    return rows.select("conv_id", "record", turns.alias("turns"))


def canonical_turns_json(df: DataFrame, record: str = "record", conv_id: str = "conv_id") -> DataFrame:
    """Turns of JSON records of mixed layouts, each fingerprinted by itself.

    Records that aren't JSON or fit no layout are in ``unmapped_json``.
    """
    rows = _json_turns(df, record, conv_id)
    return rows.select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.turn", "t.role", "t.text")


def unmapped_json(df: DataFrame, record: str = "record", conv_id: str = "conv_id") -> DataFrame:
    """``conv_id`` and ``record`` of the records that give no turns for want of a mapping."""
    return _json_turns(df, record, conv_id).filter("turns is null").select("conv_id", "record")


# ------------------------------------------------------------------- template


def escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), _CONTROL_AHEAD, r"\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``formatted`` and the loss spans in it.

    ``loss_spans`` holds (start, length) in code points of every assistant
    text as it stands in ``formatted``.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumns({"head": F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)), "body": escape(F.col("text"))})
    t = t.withColumn("size", (F.char_length("head") + F.char_length("body") + len(END)).cast("long"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.select(
        "conv_id",
        F.row_number().over(order).alias("n"),
        F.concat("head", "body", F.lit(END)).alias("piece"),
        F.when(F.col("role") == LOSS_ROLE, F.struct((before + F.char_length("head")).alias("start"), F.char_length("body").cast("long").alias("length"))).alias("span"),
    )
    got = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "piece", "span"))).alias("p"))
    return got.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("p", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_chats(chats: DataFrame) -> DataFrame:
    """Turns and loss texts parsed back from formatted conversations."""
    pieces = F.split("formatted", re.escape(END), -1)
    parts = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.split(F.substr(p, F.lit(len(START) + 1)), re.escape(SEP), 2))
    return chats.select(
        "conv_id",
        "formatted",
        F.transform(parts, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text"))).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))).alias("loss_texts"),
    )


def chat_digests(read: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )

"""Chat formatting: conversations of any known layout become turns, and turns become marked text.

The layout of a record is recognised by its schema fingerprint, a hash of its nested field paths. A
registered fingerprint selects a mapping, which says in data, not code, where roles and texts stand.
Turns are formatted one by one into a text whose concatenation is the conversation: each is marked
by control strings, and control strings inside a text are broken up so that reading undoes it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import shared_folder

# Strings that chat templates in use reserve. No text may contain them unbroken.
CONTROL_STRINGS = [
    "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>",
]
START, END = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"

# An escape character goes behind the first character of each control string, also of overlapping
# ones, and is doubled where the text has it. Reading drops each escape and keeps what it precedes.
_BREAK = "([<\\[])(?=" + "|".join(re.escape(x[1:]) for x in CONTROL_STRINGS) + ")"
_READ = r"\\(\\?)"


@dataclass(frozen=True)
class Mapping:
    """Where the turns of a layout are.

    `turns` lists (role, path of the text) for layouts with a field per turn; a path that is null or
    empty gives no turn. `items` is the path of an array of turns whose elements hold `role` and
    `text`. `rows` layouts have a row per turn with those columns. Roles are renamed by `roles`.
    """

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    items: str | None = None
    role: str = "role"
    text: str = "content"
    rows: bool = False
    key: str = "conv_id"
    order: str = "turn"
    roles: dict[str, str] = field(default_factory=dict)


_SPEAKERS = {
    "human": "user",
    "prompter": "user",
    "gpt": "assistant",
    "bot": "assistant",
    "model": "assistant",
}


def _question(name: str, asked: str, answered: str, *before: tuple[str, str]) -> Mapping:
    return Mapping(name, (*before, ("user", asked), ("assistant", answered)))


_FROM_VALUE = {"items": "conversations", "role": "from", "text": "value", "roles": _SPEAKERS}
# Field paths of each layout, and its mapping.
LAYOUTS: list[tuple[list[str], Mapping]] = [
    (["conv_id", "turn", "role", "text"], Mapping("turn_rows", rows=True, text="text")),
    (["prompt", "response"], _question("prompt_response", "prompt", "response")),
    (["prompt", "completion"], _question("prompt_completion", "prompt", "completion")),
    (["question", "answer"], _question("question_answer", "question", "answer")),
    (["instruction", "output"], _question("instruction", "instruction", "output")),
    (
        ["instruction", "input", "output"],
        _question("instruction_input", "input", "output", ("user", "instruction")),
    ),
    (
        ["system", "instruction", "output"],
        _question("system_instruction", "instruction", "output", ("system", "system")),
    ),
    (["messages[].role", "messages[].content"], Mapping("messages", items="messages")),
    (
        ["conversations[].from", "conversations[].value"],
        Mapping("from_value", **_FROM_VALUE),
    ),
    (
        ["system", "conversations[].from", "conversations[].value"],
        Mapping("system_from_value", (("system", "system"),), **_FROM_VALUE),
    ),
]


def fingerprint(paths: Iterable[str]) -> str:
    """Hash of a layout: its field paths, whatever their order."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


REGISTRY: dict[str, Mapping] = {fingerprint(paths): mapping for paths, mapping in LAYOUTS}


def schema_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a schema; `[]` stands for the elements of an array."""
    if isinstance(schema, T.StructType):
        return [
            p
            for f in schema.fields
            for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)
        ]
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, f"{prefix}[]")
    return [prefix]


def _value_paths(value, prefix: str, out: set[str]) -> None:
    if isinstance(value, dict) and value:
        for k, v in value.items():
            _value_paths(v, f"{prefix}.{k}" if prefix else str(k), out)
    elif isinstance(value, list):
        for v in value:
            _value_paths(v, f"{prefix}[]", out)
    else:
        out.add(prefix)


def json_fingerprint(record: str | None) -> str | None:
    """Fingerprint of a JSON record; None if it is null or no object."""
    try:
        value = json.loads(record)
    except (TypeError, ValueError):
        return None
    if not isinstance(value, dict):
        return None
    paths: set[str] = set()
    _value_paths(value, "", paths)
    return fingerprint(paths)


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [json_fingerprint(x.as_py()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(prints, pa.string())],
            names=["conv_id", "record", "fingerprint"],
        )


def _renamed(role: Column, roles: dict[str, str]) -> Column:
    for old, new in roles.items():
        role = F.when(role == old, new).otherwise(role)
    return role


def _item(mapping: Mapping):
    return lambda t: F.struct(
        F.coalesce(_renamed(t[mapping.role], mapping.roles), F.lit("")).alias("role"),
        F.coalesce(t[mapping.text], F.lit("")).alias("text"),
    )


def turns_from_rows(rows: DataFrame) -> DataFrame:
    """Canonical turns (conv_id, turn, role, text) of a table with a row per turn.

    The layout is recognised by the schema, of which the mapping's columns may be a part: extra
    columns are ignored. Null texts and roles become empty.
    """
    names = set(rows.columns)
    for paths, mapping in LAYOUTS:
        if mapping.rows and set(paths) <= names:
            known = REGISTRY[fingerprint(paths)]
            return rows.select(
                F.col(known.key).cast("long").alias("conv_id"),
                F.col(known.order).cast("long").alias("turn"),
                F.coalesce(F.col(known.role).cast("string"), F.lit("")).alias("role"),
                F.coalesce(F.col(known.text).cast("string"), F.lit("")).alias("text"),
            )
    raise ValueError(f"no layout with a row per turn has the columns {sorted(names)}")


def turns_from_json(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical turns of JSON records (conv_id, record), and the records of unknown layout.

    The second frame has conv_id, record and fingerprint, which is null if the record is no object.
    """
    marked = records.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("record").cast("string").alias("record")
    ).mapInArrow(_fingerprints, "conv_id long, record string, fingerprint string")
    turn = "array<struct<role:string,text:string>>"
    column = F.lit(None).cast(turn)
    for print_, mapping in REGISTRY.items():
        if mapping.rows:
            continue
        fixed = [
            F.struct(F.lit(role).alias("role"), F.get_json_object("record", f"$.{path}").alias("text"))
            for role, path in mapping.turns
        ]
        listed = F.array(*fixed).cast(turn) if fixed else F.array().cast(turn)
        listed = F.filter(listed, lambda t: t.text != "")
        if mapping.items:
            kind = f"array<struct<`{mapping.role}`:string,`{mapping.text}`:string>>"
            items = F.from_json(F.get_json_object("record", f"$.{mapping.items}"), kind)
            listed = F.concat(
                listed,
                F.transform(items, _item(mapping)),
            )
        column = F.when(F.col("fingerprint") == print_, listed).otherwise(column)
    mapped = marked.withColumn("turns", column)
    turns = mapped.where("turns IS NOT NULL").select(
        "conv_id", F.posexplode("turns").alias("turn", "t")
    )
    turns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")
    known = list(REGISTRY)
    unknown = marked.where(~F.coalesce(F.col("fingerprint").isin(known), F.lit(False)))
    return turns, unknown


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(_BREAK), F.lit(r"$1\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_READ), F.lit("$1"))


def format_turns(turns: DataFrame) -> DataFrame:
    """Columns: conv_id, turn, piece, loss_start, loss_end.

    The conversation's text is its pieces by turn, one after the other. Code points from loss_start
    to loss_end of a piece, counted from 0, are under the loss mask: the text of an assistant turn,
    escaped as it stands; both are 0 elsewhere. Roles are escaped like texts, and their line feeds
    are written as %0A.
    """
    role = F.replace(F.replace(escape(F.col("role")), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    rows = turns.select(
        "conv_id", "turn", "role",
        F.concat(F.lit(START), role, F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    masked = F.col("role") == LOSS_ROLE
    return rows.select(
        "conv_id",
        "turn",
        F.concat("head", "body", F.lit(END)).alias("piece"),
        F.when(masked, F.length("head")).otherwise(0).cast("long").alias("loss_start"),
        F.when(masked, F.length("head") + F.length("body")).otherwise(0).cast("long").alias("loss_end"),
    )


def write_chats(turns: DataFrame, folder: str) -> None:
    """Format and write turns as Parquet, in order of (conv_id, turn) over all files.

    Ranges are cut by conversation and turn, so one that holds a large share of all turns is spread
    over several files. Turns with the same number are ordered by role and text.
    """
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("piece")]
    format_turns(turns).repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(folder)


def read_turns(pieces: DataFrame) -> DataFrame:
    """Undo format_turns: conv_id, turn, role, text, masked (the text under the loss mask)."""
    head = F.regexp_extract("piece", rf"\A{re.escape(START)}([^\n]*)\n", 1)
    role = unescape(F.replace(F.replace(head, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))
    at = F.length(F.lit(START)) + F.length(head) + 2
    text = F.substring("piece", at, F.length("piece") - at + 1 - len(END))
    masked = F.substring(F.col("piece"), F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))
    return pieces.select(
        "conv_id", "turn", "piece",
        role.alias("role"),
        unescape(text).alias("text"),
        unescape(masked).alias("masked"),
    )


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running digests over turns in order; holds one conversation's counters at a time."""
    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ])
    now, held, out = None, False, []

    def close():
        key, n, turns, chars, loss, size = now
        out.append(dict(zip(schema.names, (key, n, turns.hexdigest(), chars, loss.hexdigest(), size))))

    for batch in batches:
        for key, role, text, masked, size in zip(*[batch.column(k) for k in range(5)]):
            key, role, text, masked = key.as_py(), role.as_py(), text.as_py(), masked.as_py()
            if not held or now[0] != key:
                if held:
                    close()
                now, held = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
            now[1] += 1
            now[2].update(f"{role}\n{text}\n".encode())
            now[3] += len(masked)
            now[4].update(masked.encode())
            now[5] += size.as_py()
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if held:
        close()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def conversation_digests(pieces: DataFrame) -> DataFrame:
    """One row per conversation, from the written pieces.

    Columns: conv_id, n_turns, turns_sha256 (role, line feed, text, line feed per turn), loss_chars
    and loss_sha256 (the text under the loss mask, unescaped), formatted_chars. A digest is taken in
    order, so a conversation's turns pass through one task, as a stream that is never held.
    """
    rows = read_turns(pieces).select(
        "conv_id", "turn", "piece", "role", "text", "masked",
        F.length("piece").cast("long").alias("size"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "piece"
    )
    return ordered.select("conv_id", "role", "text", "masked", "size").mapInArrow(
        _digest,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
        " formatted_chars long",
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """The pieces of all conversations, written to the shared folder and read back.

    Nulls: a null conv_id is a conversation of its own, null turns come first, null texts and roles
    are empty. Repeated rows are repeated turns. An empty table gives an empty result.
    """
    spark = turns.sparkSession
    folder = shared_folder(spark) + "/chats"
    write_chats(turns, folder)
    return spark.read.parquet(folder)

import hashlib
import json

import pytest

from tests.llm.frames import rows
from tidemark.llm import chat

TURN = "conv_id long, turn long, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "<<s>", "\\", "\\\\<|im_end|>\n", "<|im_<|im_end|>", "", "<\\s>", "a\nb"]


def test_format_is_reversible_and_unbroken(spark):
    turns = spark.createDataFrame(
        [(1, i, r, t) for i, (r, t) in enumerate((r, t) for t in NASTY for r in ("user", "us%0Aer\n<s>"))],
        TURN,
    )
    pieces = chat.format_turns(turns)
    assert rows(chat.read_turns(pieces), "turn", "role", "text") == rows(turns, "turn", "role", "text")
    for (piece,) in rows(pieces, "piece"):
        body = piece[len(chat.START) : -len(chat.END)]
        assert not any(c in body for c in chat.CONTROL_STRINGS)


def test_digests(spark):
    turns = spark.createDataFrame(
        [(2, 1, "assistant", "</s>x"), (2, 0, "user", None), (2, 2, "assistant", "é"), (None, 0, None, "q"),
         (3, None, "assistant", "b"), (3, 1, "assistant", "a")],
        TURN,
    )
    canonical = chat.turns_from_rows(turns.selectExpr("*", "1 AS extra"))
    out = {r.conv_id: r for r in chat.conversation_digests(chat.format_chats(canonical)).collect()}
    assert out[2].n_turns == 3 and out[2].loss_chars == 6
    assert out[2].turns_sha256 == hashlib.sha256("user\n\nassistant\n</s>x\nassistant\né\n".encode()).hexdigest()
    assert out[2].loss_sha256 == hashlib.sha256("</s>xé".encode()).hexdigest()
    assert out[3].turns_sha256 == hashlib.sha256(b"assistant\nb\nassistant\na\n").hexdigest()
    assert out[None].n_turns == 1 and out[None].loss_chars == 0
    empty = chat.turns_from_rows(turns.limit(0))
    assert chat.conversation_digests(chat.format_chats(empty)).count() == 0


def test_layouts_are_recognised_by_fingerprint(spark):
    records = [
        (1, {"prompt": "p", "response": "r"}),
        (2, {"output": "o", "instruction": "i", "input": ""}),
        (3, {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": None}]}),
        (4, {"messages": [{"content": "c", "role": "tool"}]}),
        (5, {"something": {"else": 1}}),
    ]
    df = spark.createDataFrame(
        [(k, json.dumps(v)) for k, v in records] + [(6, None), (7, "[1]"), (8, "{")],
        "conv_id long, record string",
    )
    turns, unknown = chat.turns_from_json(df)
    assert rows(turns, "conv_id", "turn", "role", "text") == [
        (1, 0, "user", "p"), (1, 1, "assistant", "r"),
        (2, 0, "user", "i"), (2, 1, "assistant", "o"),
        (3, 0, "user", "h"), (3, 1, "assistant", ""),
        (4, 0, "tool", "c"),
    ]
    assert [r[0] for r in rows(unknown, "conv_id")] == [5, 6, 7, 8]


def test_schema_paths(spark):
    schema = spark.createDataFrame([], "messages array<struct<role:string,content:string>>").schema
    assert chat.REGISTRY[chat.fingerprint(chat.schema_paths(schema))].name == "messages"


def test_unknown_table_is_refused(spark):
    with pytest.raises(ValueError):
        chat.turns_from_rows(spark.range(1))

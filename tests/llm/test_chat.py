import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodekey.llm import chat


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


TEXTS = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<|im_start|>user<|im_sep|>x<|im_end|>", "<", "<<s>", "<\\s>", "", None, "a\nb\\", "[INST", "<<SYS>>é\U0001f600"]


def test_round_trip(spark):
    rows = [(i % 2, i, "assistant" if i % 3 else "user", t) for i, t in enumerate(TEXTS)] + [(7, 0, None, "x"), (7, 0, "assistant", "y"), (7, 0, "assistant", "y"), (None, None, "we<s>ird", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    chats = chat.format_chats(chat.canonical_turns(df))
    for r in chats.collect():
        for c in chat.CONTROLS:
            assert c in (chat.START, chat.SEP, chat.END) or c not in r.formatted
    got = {r.conv_id: r for r in chat.chat_digests(chat.read_chats(chats)).collect()}
    for conv in (0, 1, 7, None):
        mine = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda k: (k[0] is not None, k))
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert got[conv].n_turns == len(mine)
        assert got[conv].turns_sha256 == digest("".join(f"{r}\n{x}\n" for _, r, x in mine))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), digest(loss))


def test_layouts(spark):
    turns = lambda df: [(r.role, r.text) for r in chat.canonical_turns(df).orderBy("conv_id", "turn").collect()]
    assert turns(spark.createDataFrame([(1, "q", "a", "en")], "conv_id long, prompt string, response string, lang string")) == [("user", "q"), ("assistant", "a")]
    assert turns(spark.createDataFrame([(1, "do", "this", "done")], "conv_id long, instruction string, input string, output string")) == [("user", "do\nthis"), ("assistant", "done")]
    assert turns(spark.createDataFrame([(1, "do", None, None)], "conv_id long, instruction string, input string, output string")) == [("user", "do"), ("assistant", "")]
    assert turns(spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")]), (2, None)], "conv_id long, conversations array<struct<from:string,value:string>>")) == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError):
        turns(spark.createDataFrame([(1, "q")], "conv_id long, question string"))


def test_columns_of_other_layouts_are_extra(spark):
    rows = [(1, 0, "human", "q"), (1, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = [tuple(r) for r in chat.canonical_turns(df).orderBy("turn").collect()]
    assert want == rows
    for p in sorted(chat.KNOWN_PATHS):
        name, _, field = p.partition("[].")
        if name not in df.columns:
            extra = F.array(F.struct(F.lit("x").alias("role"), F.lit("x").alias(field))) if field else F.lit("x")
            df = df.withColumn(name, extra)
            assert [tuple(r) for r in chat.canonical_turns(df).orderBy("turn").collect()] == want
    assert chat.select_mapping(df.drop("turn").schema).messages
    assert chat.select_mapping(df.drop("turn", "messages", "conversations").schema).name == "system_prompt_response"


def test_mixed_records(spark):
    records = [
        {"prompt": "q", "response": "a", "more": {"x": 1}},
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "weight": 1}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "output": "a"},
        {"prompt": "q", "response": "a", "input": "unused", "completion": "unused"},
        {"unknown": 1},
        {"role": "gpt", "text": "t", "turn": 3},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(9, "not json"), (10, None)], "conv_id long, record string")
    got: dict = {}
    for r in chat.canonical_turns_json(df).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {i: [("user", "q"), ("assistant", "a")] for i in range(5)} | {6: [("gpt", "t")]}
    assert sorted(r.conv_id for r in chat.unmapped_json(df).collect()) == [5, 9, 10]


def test_native_and_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = chat.chat_digests(chat.read_chats(chat.format_chats(chat.canonical_turns(df))))
    assert out.collect() == []
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan

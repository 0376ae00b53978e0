"""Messages to both request shapes and replies back, beside plain Python."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from siftwell.operators import messages as M

CONVERSATION = [
    ("system", "Be brief.", None, None, None), ("system", "", None, None, None), ("system", "In German.", None, None, None), ("user", 'Weather in "Köln"?\n\t', None, None, None),
    ("assistant", None, None, None, [("c1", "weather", '{"b": [1, 2.5, null], "a": {"x": "é"}}'), ("c2", "clock", ""), ("c3", "odd", "not json"), ("c4", "list", "[1]")]),
    ("tool", '{"celsius": 3}', "weather", "c1", None), ("tool", "plain", "", "c2", None), ("tool", None, None, None, None), ("assistant", "", None, None, []), ("assistant", "3 degrees", None, None, None), (None, "who?", None, None, None),
]


def _one(spark, value, schema, *columns):
    return spark.createDataFrame([(value,)], f"v {schema}").select(*(c(F.col("v")).alias(f"c{k}") for k, c in enumerate(columns))).first()


def test_requests(spark):
    row = _one(spark, CONVERSATION, f"array<{M.MESSAGE}>", M.system_text, M.chat_messages, M.parts_contents)
    chat, parts = json.loads(row["c1"]), json.loads(row["c2"])
    assert row["c0"] == "Be brief.\n\nIn German." and len(chat) == len(CONVERSATION)
    assert chat[3] == {"role": "user", "content": 'Weather in "Köln"?\n\t'} and chat[4]["content"] == "" and "tool_calls" not in chat[8]
    assert chat[4]["tool_calls"][0] == {"id": "c1", "type": "function", "function": {"name": "weather", "arguments": '{"b": [1, 2.5, null], "a": {"x": "é"}}'}}
    assert chat[5] == {"role": "tool", "content": '{"celsius": 3}', "name": "weather", "tool_call_id": "c1"} and "name" not in chat[6]
    assert [t["role"] for t in parts] == ["user", "model", "user", "user", "user", "model", "user"]
    assert [p["functionCall"] for p in parts[1]["parts"]] == [{"name": "weather", "args": {"a": {"x": "é"}, "b": [1, 2.5, None]}}, {"name": "clock", "args": {}}, {"name": "odd", "args": {"result": "not json"}}, {"name": "list", "args": {"result": [1]}}]
    assert [t["parts"][0]["functionResponse"] for t in parts[2:5]] == [{"name": "weather", "response": {"celsius": 3}}, {"name": "tool", "response": {"result": "plain"}}, {"name": "tool", "response": {}}]
    assert parts[5]["parts"] == [{"text": "3 degrees"}] and parts[6]["parts"] == [{"text": "who?"}]
    none = spark.createDataFrame([(None,), ([],)], f"v array<{M.MESSAGE}>").select(M.system_text(F.col("v")), M.chat_messages(F.col("v")), M.parts_contents(F.col("v"))).collect()
    assert list(none[1]) == ["", "[]", "[]"] and none[0][1] is None
    assert spark.createDataFrame([], f"v array<{M.MESSAGE}>").select(M.parts_contents(F.col("v"))).count() == 0


def test_tools(spark):
    tools = [{"type": "function", "function": {"name": "f", "parameters": {"type": "object", "properties": {"q": {"type": "string"}}}}}, {"name": "g", "description": "d"}]
    (made,) = json.loads(_one(spark, json.dumps(tools), "string", M.parts_tools)["c0"])
    assert made["function_declarations"] == [{"name": "f", "description": "", "parameters": tools[0]["function"]["parameters"]}, {"name": "g", "description": "d", "parameters": {"type": "object", "properties": {}}}]
    assert [_one(spark, v, "string", M.parts_tools)["c0"] for v in ("[]", "", None, "{}")] == ["[]"] * 4


def test_chat_replies(spark):
    read = lambda v: _one(spark, v if v is None or isinstance(v, str) else json.dumps(v), "string", M.read_chat_reply)["c0"]
    full = read({"choices": [{"message": {"content": "hi", "tool_calls": [{"id": 7, "function": {"name": "f", "arguments": '{"a": 1}'}}, "odd", {"function": {"name": "g", "arguments": {"k": [1]}}}, {}, {"id": "", "function": {"arguments": {}}}]}}]})
    assert full["content"] == "hi" and [tuple(c) for c in full["tool_calls"]] == [("7", "f", '{"a": 1}'), ("g", "g", '{"k":[1]}'), ("tool", "", "{}"), ("tool", "", "{}")]
    bare = read({"choices": [{"message": {"content": None}}]})
    assert bare is not None and bare["content"] is None and bare["tool_calls"] == []
    assert [read(v) for v in ({"choices": []}, {}, [], "not json", "", None)] == [None] * 6


def test_parts_replies(spark):
    read = lambda v: _one(spark, v if v is None or isinstance(v, str) else json.dumps(v), "string", M.read_parts_reply)["c0"]
    whole = lambda parts: {"candidates": [{"content": {"parts": parts}}]}
    full = read(whole([{"text": "a"}, "odd", {"text": None}, {"functionCall": {"name": "f", "args": {"b": 1, "a": None}}}, {"text": "b"}, {"function_call": {"name": "g", "arguments": "raw"}}, {"functionCall": {"name": ""}}, {"functionCall": {"name": "h"}}]))
    assert full["content"] == "ab" and [tuple(c) for c in full["tool_calls"]] == [("call_3_f", "f", '{"a":null,"b":1}'), ("call_5_g", "g", "raw"), ("call_7_h", "h", "{}")]
    assert read(whole([]))["content"] is None and read(whole({"x": 1}))["tool_calls"] == []
    assert [read(v) for v in ({"candidates": []}, {"candidates": [{}]}, "x", "", None)] == [None] * 5

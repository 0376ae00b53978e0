"""Messages and replies of model providers, as VARIANT: one shape of a message to two request shapes and back.

A message is ``struct<role, content, name, tool_call_id, tool_calls: array<struct<id, name, arguments>>>``;
``arguments`` is JSON as text.  Chat requests list messages with their roles; parts requests know the
turns ``user`` and ``model``, have no system turns (those are one text beside them) and hold calls as
objects.  Everything is a Column expression, so that nothing but the messages' own rows is read.

Objects that pass through a VARIANT have their keys sorted, and JSON text made from it has no blanks.
JSON with a repeated key is taken as text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.text import bound

CALL = "struct<id:string,name:string,arguments:string>"
MESSAGE = f"struct<role:string,content:string,name:string,tool_call_id:string,tool_calls:array<{CALL}>>"


def _filled(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING and so on; empty without a value."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0), F.lit(""))


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _truthy_text(v: Column) -> Column:
    """A value as text where it is neither missing, null, empty, zero nor false; else null."""
    return bound(v, lambda x: F.when(_kind(x).isin("", "VOID"), F.lit(None)).otherwise(F.nullif(F.nullif(F.nullif(F.nullif(F.nullif(_at(x, "$", "string"), F.lit("")), F.lit("0")), F.lit("false")), F.lit("{}")), F.lit("[]"))))


def json_object(raw: Column) -> Column:
    """An object as a variant: empty for no text; what is no object, and text that is no JSON, is held under ``result``."""

    def made(text: Column) -> Column:
        wrap = lambda value: F.to_variant_object(F.struct(value.alias("result")))
        read = F.try_parse_json(text)
        return F.when(_filled(text).isNull(), F.parse_json(F.lit("{}"))).when(read.isNull(), wrap(text)).when(_kind(read) == "OBJECT", read).otherwise(wrap(read))

    return bound(raw, made)


# -------------------------------------------------------------------- requests


def system_text(messages: Column) -> Column:
    """The system turns as one text."""
    return F.array_join(F.transform(F.filter(messages, lambda m: (m["role"] == "system") & _filled(m["content"]).isNotNull()), lambda m: m["content"]), "\n\n")


def _chat_message(m: Column) -> Column:
    calls = F.transform(m["tool_calls"], lambda c: F.struct(c["id"].alias("id"), F.lit("function").alias("type"), F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")).alias("function")))
    return F.struct(
        m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"), _filled(m["name"]).alias("name"), _filled(m["tool_call_id"]).alias("tool_call_id"),
        F.when(F.size(m["tool_calls"]) > 0, calls).alias("tool_calls"),
    )


def chat_messages(messages: Column) -> Column:
    """The JSON of a chat request's messages; what a message lacks is left out."""
    return F.to_json(F.transform(messages, _chat_message))


_PART = "struct<text:string,functionCall:struct<name:string,args:variant>,functionResponse:struct<name:string,response:variant>>"


def _part(text: Column | None = None, call: Column | None = None, response: Column | None = None) -> Column:
    none = F.lit(None)
    own = F.struct((none if text is None else text).alias("text"), (none if call is None else call).alias("functionCall"), (none if response is None else response).alias("functionResponse"))
    return own.cast(_PART)


def _turn(m: Column) -> Column:
    answer = _part(response=F.struct(F.coalesce(_filled(m["name"]), F.lit("tool")).alias("name"), json_object(m["content"]).alias("response")))
    said = F.when(_filled(m["content"]).isNotNull(), F.array(_part(text=m["content"]))).otherwise(F.array().cast(f"array<{_PART}>"))
    calls = F.coalesce(F.transform(m["tool_calls"], lambda c: _part(call=F.struct(c["name"].alias("name"), json_object(c["arguments"]).alias("args")))), F.array().cast(f"array<{_PART}>"))
    parts = F.when(m["role"] == "tool", F.array(answer)).when(m["role"] == "assistant", F.concat(said, calls)).otherwise(F.array(_part(text=F.coalesce(m["content"], F.lit("")))))
    return F.struct(F.when(m["role"] == "assistant", "model").otherwise("user").alias("role"), parts.alias("parts"))


def parts_contents(messages: Column) -> Column:
    """The JSON of a parts request's turns: no system turns, no assistant turns that hold nothing."""
    turns = F.transform(F.filter(messages, lambda m: F.coalesce(m["role"] != "system", F.lit(True))), _turn)
    return F.to_json(F.filter(turns, lambda t: F.size(t["parts"]) > 0))


def parts_tools(tools: Column) -> Column:
    """Function declarations of a parts request from the JSON list of a chat request's tools; ``[]`` without any."""

    def declared(t: Column) -> Column:
        fn = F.when((_at(t, "$.type", "string") == "function") & (_kind(_at(t, "$.function")) == "OBJECT"), _at(t, "$.function")).otherwise(t)
        blank = F.parse_json(F.lit('{"properties":{},"type":"object"}'))
        parameters = F.when(_truthy_text(_at(fn, "$.parameters")).isNotNull(), _at(fn, "$.parameters")).otherwise(blank)
        return F.struct(_at(fn, "$.name", "string").alias("name"), F.coalesce(_at(fn, "$.description", "string"), F.lit("")).alias("description"), parameters.alias("parameters"))

    made = F.transform(_at(F.try_parse_json(tools), "$", "array<variant>"), declared)
    return F.when(F.coalesce(F.size(made), F.lit(0)) > 0, F.to_json(F.array(F.struct(made.alias("function_declarations"))))).otherwise(F.lit("[]"))


# --------------------------------------------------------------------- replies


def _arguments(v: Column) -> Column:
    """Arguments as JSON text: text as it is, nothing as an empty object."""
    return bound(v, lambda x: F.when(_kind(x) == "STRING", _at(x, "$", "string")).when(_truthy_text(x).isNull(), F.lit("{}")).otherwise(F.to_json(x)))


def read_chat_reply(reply: Column) -> Column:
    """``struct<content, tool_calls>`` of a chat reply; null where it is none."""

    def call(raw: Column) -> Column:
        name = _truthy_text(_at(raw, "$.function.name"))
        ident = F.coalesce(_truthy_text(_at(raw, "$.id")), name, F.lit("tool"))
        return F.struct(ident.alias("id"), F.coalesce(name, F.lit("")).alias("name"), _arguments(_at(raw, "$.function.arguments")).alias("arguments"))

    def read(message: Column) -> Column:
        calls = F.transform(F.filter(_at(message, "$.tool_calls", "array<variant>"), lambda c: _kind(c) == "OBJECT"), call)
        return F.when(_kind(message) == "OBJECT", F.struct(_at(message, "$.content", "string").alias("content"), F.coalesce(calls, F.array().cast(f"array<{CALL}>")).alias("tool_calls")))

    return bound(_at(F.try_parse_json(reply), "$.choices[0].message"), read)


def read_parts_reply(reply: Column) -> Column:
    """``struct<content, tool_calls>`` of a parts reply; texts are joined, calls named by their place; null where it is none."""

    def call(part: Column, place: Column) -> Column:
        first, second = _at(part, "$.functionCall"), _at(part, "$.function_call")
        fn = F.when(_truthy_text(first).isNotNull(), first).otherwise(second)
        given = F.when(_at(fn, "$.args").isNotNull(), _at(fn, "$.args")).otherwise(_at(fn, "$.arguments"))
        name = F.when(_kind(fn) == "OBJECT", _truthy_text(_at(fn, "$.name")))
        return F.struct(F.concat(F.lit("call_"), place.cast("string"), F.lit("_"), name).alias("id"), name.alias("name"), _arguments(given).alias("arguments"))

    def read(parts: Column) -> Column:
        listed = F.coalesce(_at(parts, "$", "array<variant>"), F.array().cast("array<variant>"))
        own = F.transform(listed, lambda p, k: F.struct(F.when(_kind(p) == "OBJECT", p).alias("p"), k.alias("k")))
        texts = F.filter(F.transform(own, lambda o: _at(o["p"], "$.text", "string")), lambda t: t.isNotNull())
        calls = F.filter(F.transform(own, lambda o: call(o["p"], o["k"])), lambda c: c["name"].isNotNull())
        return F.when(parts.isNotNull(), F.struct(F.when(F.size(texts) > 0, F.array_join(texts, "")).alias("content"), calls.alias("tool_calls")))

    return bound(_at(F.try_parse_json(reply), "$.candidates[0].content.parts"), read)

"""Queries over ``conversations``: message text in the place of post text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import hashtags, text_of, without_doubling
from siftwell.operators.messages import MESSAGE, chat_messages, parts_contents, read_chat_reply, read_parts_reply, system_text
from siftwell.operators.verdicts import is_seeking
from siftwell.plans.registry import query, table

_SEEK = r"(?i)\b(i[''’]?m|i am|we are)\s+(actively\s+)?looking\s+for\b|\bopen\s+to\s+(work|opportunities|internships?)\b|\bplease\s+(refer|refer me)\b|\b(seeking|looking for)\s+(an?\s+)?(internship|intern\s+role|opportunity)\b"


@query(f"SELECT conv_id, turn, regexp_matches(coalesce(text, ''), '{_SEEK}') AS seeking FROM conversations")
def conversation_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", is_seeking(text_of("text")).alias("seeking"))


@query(r"SELECT role, count(*) AS n, sum(len(regexp_extract_all(coalesce(text, ''), '(?:^|\s)#\w+')))::BIGINT AS tags FROM conversations GROUP BY role")
def message_hashtags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(hashtags(text_of("text"))).cast("long").alias("tags"))


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS answers, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def conversation_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "assistant").alias("answers"), F.max_by("role", "turn").alias("last_role"))


@query(r"WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS ls FROM conversations), d AS (SELECT conv_id, turn, list_filter(ls, lambda x, i: list_position(ls, x) = i) AS ds FROM l) SELECT conv_id, turn, len(ds) AS n_lines FROM d")
def distinct_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.transform(F.split(text_of("text"), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    out = table(spark, sf_dir, "conversations").withColumn("line", without_doubling(text_of("text")))
    return out.select("conv_id", "turn", F.size(F.array_distinct(lines)).cast("long").alias("n_lines"))


@query(
    """WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations)
    SELECT conv_id, turn, role AS chat_role, sha256(t) AS chat_sha256, CASE WHEN role = 'system' THEN sha256(t) ELSE sha256('') END AS system_sha256,
    CASE WHEN role = 'system' OR (role = 'assistant' AND t = '') THEN 0 ELSE 1 END AS n_turns, CASE WHEN role = 'system' OR (role = 'assistant' AND t = '') THEN NULL WHEN role = 'assistant' THEN 'model' ELSE 'user' END AS parts_role,
    CASE WHEN role = 'system' OR (role = 'assistant' AND t = '') THEN NULL ELSE sha256(t) END AS parts_sha256 FROM c"""
)
def provider_requests_of_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn in both request shapes, read back from their JSON."""
    own = F.struct(F.col("role"), F.col("text").alias("content"), F.lit(None).alias("name"), F.lit(None).alias("tool_call_id"), F.array().alias("tool_calls")).cast(MESSAGE)
    made = table(spark, sf_dir, "conversations").withColumn("m", F.array(own)).select("conv_id", "turn", chat_messages(F.col("m")).alias("chat"), parts_contents(F.col("m")).alias("parts"), system_text(F.col("m")).alias("system"))
    chat = F.from_json("chat", "array<struct<role:string,content:string>>")[0]
    turns = F.from_json("parts", "array<struct<role:string,parts:array<struct<text:string>>>>")
    first = F.try_element_at(turns, F.lit(1))
    return made.select(
        "conv_id", "turn", chat["role"].alias("chat_role"), F.sha2(chat["content"], 256).alias("chat_sha256"), F.sha2("system", 256).alias("system_sha256"),
        F.size(turns).alias("n_turns"), first["role"].alias("parts_role"), F.sha2(first["parts"][0]["text"], 256).alias("parts_sha256"),
    )


@query(
    """SELECT conv_id, turn, shape, CASE WHEN shape = 'chat' THEN sha256(t) WHEN t = '' THEN sha256('done') ELSE sha256(t || 'done') END AS content_sha256, CASE WHEN shape = 'chat' THEN 'id' || turn WHEN t = '' THEN 'call_1_' || role ELSE 'call_2_' || role END AS call_id,
    role AS call_name, sha256(t) AS argument_sha256, turn AS argument_n FROM (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations), (VALUES ('chat'), ('parts')) s(shape)"""
)
def provider_replies_of_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a reply of either kind that calls a function with the text; both are read into one shape."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text_of("text").alias("t"))
    given = F.struct(F.col("turn").alias("n"), F.col("t").alias("q"))
    call = F.struct(F.concat(F.lit("id"), F.col("turn").cast("string")).alias("id"), F.struct(F.col("role").alias("name"), F.to_json(given).alias("arguments")).alias("function"))
    chat = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("t").alias("content"), F.array(call).alias("tool_calls")).alias("message"))).alias("choices")))
    part = "struct<text:string,functionCall:struct<name:string,args:struct<n:bigint,q:string>>>"
    said = lambda c: F.struct(c.alias("text"), F.lit(None).alias("functionCall")).cast(part)
    asked = F.struct(F.lit(None).alias("text"), F.struct(F.col("role").alias("name"), given.alias("args")).alias("functionCall")).cast(part)
    listed = F.when(F.col("t") == "", F.array(said(F.lit("done")), asked)).otherwise(F.array(said(F.col("t")), said(F.lit("done")), asked))
    parts = F.to_json(F.struct(F.array(F.struct(F.struct(listed.alias("parts")).alias("content"))).alias("candidates")))
    both = F.explode(F.array(F.struct(F.lit("chat").alias("shape"), read_chat_reply(chat).alias("reply")), F.struct(F.lit("parts").alias("shape"), read_parts_reply(parts).alias("reply"))))
    read = rows.select("conv_id", "turn", both.alias("o")).select("conv_id", "turn", "o.*").withColumn("call", F.col("reply.tool_calls")[0])
    back = F.from_json("call.arguments", "n bigint, q string")
    return read.select("conv_id", "turn", "shape", F.sha2("reply.content", 256).alias("content_sha256"), F.col("call.id").alias("call_id"), F.col("call.name").alias("call_name"), F.sha2(back["q"], 256).alias("argument_sha256"), back["n"].alias("argument_n"))

"""Chat formatting with relational operators only (operator 6).

Turns are collected as structs, sorted, adjacent turns of one role merged by an
array aggregation, and the text concatenated; everything is a Spark expression.

Template: a block of a role that is not trained on is ``[INST]role\\ntext[/INST]``,
a trained one is ``<s>role\\ntext</s>``; texts of merged turns are joined by
``[SEP]``.  Those five strings are the controls.  Inside a text, ``~`` becomes
``~0`` and ``~1`` is put behind the first character of a control, so that a text
never holds a control and :func:`read_back` restores it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED = "assistant"
_CONTROL = r"([\[<])(?=INST\]|/INST\]|SEP\]|s>|/s>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("~"), F.lit("~0")), _CONTROL, "$1~1")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~1"), F.lit("")), F.lit("~0"), F.lit("~"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("~2"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("~2"), F.lit("\n")))


def format_chat(conversations: DataFrame, trained: str = TRAINED) -> DataFrame:
    """``conv_id, n_blocks, formatted, loss_spans`` (code points, end exclusive; escaped assistant texts).

    Input: ``conv_id, turn, role, text``; other columns are ignored.  Null role or
    text is the empty string; a null conv_id is a conversation of its own; turns that
    tie on ``turn`` are ordered by role, then text, and repeated rows stay repeated
    turns.  An empty table gives an empty one.  A conversation becomes one row, so it
    has to fit a Spark string; no other group is collected.
    """
    turns = conversations.select(
        "conv_id",
        F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    collected = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    one = F.transform("turns", lambda t: F.struct(_escape_role(t["role"]).alias("role"), F.array(escape(t["text"])).alias("texts")))

    def merge(acc: Column, t: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["role"].alias("role"), F.concat(last["texts"], t["texts"]).alias("texts"))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["role"] == t["role"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(t)))

    empty = F.expr("cast(array() as array<struct<role:string,texts:array<string>>>)")
    blocks = collected.select("conv_id", F.aggregate(one, empty, merge).alias("blocks"))
    is_trained = lambda b: b["role"] == F.lit(trained)
    pieces = F.transform(
        "blocks",
        lambda b: F.concat(F.when(is_trained(b), F.lit("<s>")).otherwise(F.lit("[INST]")), b["role"], F.lit("\n"), F.array_join(b["texts"], "[SEP]"), F.when(is_trained(b), F.lit("</s>")).otherwise(F.lit("[/INST]"))),
    )
    made = blocks.select("conv_id", F.size("blocks").cast("long").alias("n_blocks"), F.array_join(pieces, "").alias("formatted"))
    return made.withColumn("loss_spans", _loss_spans(F.col("formatted"), trained))


def _loss_spans(formatted: Column, trained: str) -> Column:
    """Where the trained texts stand, read off the formatted string itself."""
    start = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")

    def step(acc: Column, part: Column) -> Column:
        # a part is one block or, inside a trained block, one text with what closes it
        lead = F.when(part.startswith(f"<s>{trained}\n"), F.lit(len(trained) + 4)).otherwise(F.lit(0))
        inside = acc["inside"] | part.startswith("<s>")
        tail = F.when(part.endswith("[SEP]"), F.lit(5)).when(part.endswith("</s>"), F.lit(4)).otherwise(F.lit(0))
        length = F.char_length(part).cast("long")
        span = F.struct((acc["pos"] + lead).alias("start"), (acc["pos"] + length - tail).alias("end"))
        return F.struct(
            (acc["pos"] + length).alias("pos"),
            F.when(part.endswith("[/INST]") | part.endswith("</s>"), F.lit(False)).otherwise(inside).alias("inside"),
            F.when(inside, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    parts = F.split(formatted, r"(?<=\[/INST\]|</s>|\[SEP\])")
    begin = F.struct(F.lit(0).cast("long").alias("pos"), F.lit(False).alias("inside"), start.alias("spans"))
    return F.aggregate(F.filter(parts, lambda p: p != ""), begin, step, lambda acc: acc["spans"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted rows: ``turns`` as ``array<struct<role, text>>`` and ``loss_text`` cut out by the spans."""
    blocks = F.filter(F.split("formatted", r"(?<=\[/INST\]|</s>)"), lambda b: b != "")
    inner = F.transform(blocks, lambda b: F.regexp_replace(b, r"^(?:<s>|\[INST\])|(?:</s>|\[/INST\])\z", ""))
    turns = F.flatten(
        F.transform(
            inner,
            lambda b: F.transform(
                F.split(F.substr(b, F.instr(b, "\n") + 1), r"\[SEP\]"),
                lambda t: F.struct(_unescape_role(F.substring_index(b, "\n", 1)).alias("role"), unescape(t).alias("text")),
            ),
        )
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return formatted.withColumns({"turns": turns, "loss_text": loss})

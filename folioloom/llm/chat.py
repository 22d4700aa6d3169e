"""Chat formatting in Spark expressions only.

A conversation's turns are collected as structs and sorted; neighbouring turns
of one role share a header, with a mark between their texts, so that every turn
can be read back:

    ### user: text</turn>\n### assistant: text<sep>text</turn>\n

Texts and roles are escaped: backslash as \\b, < as \\l, ### as \\h, and in roles
a colon as \\c; no control string can come from a text.  The loss mask is a list
of spans (start and length in code points of the output), one an assistant text.

Null text or role: empty.  Turns with equal numbers go by role, then text; null
turn numbers come first.  Rows with a null conv_id are one conversation.  An
empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sums_before

ASSISTANT = "assistant"
HEAD, COLON, BETWEEN, END = "### ", ": ", "<sep>", "</turn>\n"
#: In the order of escaping; the backslash first, and last when reading.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("###", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escaped(text: Column, escapes=ESCAPES) -> Column:
    for plain, code in escapes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, escapes=ESCAPES) -> Column:
    for plain, code in reversed(escapes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans of each conversation of turns (conv_id, turn, role, text)."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    role = lambda i: F.get("turns", i)["role"]
    piece = lambda t, i: F.struct(
        F.when((i > 0) & (role(i - 1) == t["role"]), F.lit(BETWEEN)).otherwise(F.concat(F.lit(HEAD), escaped(t["role"], ROLE_ESCAPES), F.lit(COLON))).alias("head"),
        escaped(t["text"]).alias("body"),
        F.when(role(i + 1) == t["role"], F.lit("")).otherwise(F.lit(END)).alias("tail"),
        (t["role"] == ASSISTANT).alias("loss"),
    )
    chats = chats.withColumn("pieces", F.transform("turns", piece))
    whole = lambda p: F.concat(p["head"], p["body"], p["tail"])
    starts = sums_before(F.transform("pieces", lambda p: F.length(whole(p))))
    spans = F.zip_with("pieces", starts, lambda p, at: F.when(p["loss"], F.struct((at + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))))
    return chats.select("conv_id", F.array_join(F.transform("pieces", whole), "").alias("formatted"), F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns of a formatted conversation."""
    blocks = F.split(formatted, END)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        parts = F.split(block, COLON, 2)
        role = unescaped(F.substr(parts[0], F.lit(len(HEAD) + 1)), ROLE_ESCAPES)
        return F.transform(F.split(parts[1], BETWEEN), lambda x: F.struct(role.alias("role"), unescaped(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask."""
    return F.transform(spans, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["length"])))

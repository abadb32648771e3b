r"""Chat formatting by prefix-target expansion, with DataFrame functions only.

A turn is rendered as `<s>role<|>text</s>` and a line feed. Inside roles and texts a backslash becomes two, and one is
put after the first character of every control string (`<s>`, `</s>`, `<|`, `[INST]`, `[/INST]`), so a text can't end
its turn, and taking the backslashes away gives the text back. Every assistant turn makes an example: all preceding
turns as context, and the loss span over the reply alone. Turns after the last reply, or a conversation without one,
make a last example with an empty span, so that no turn is lost.

The turns of a conversation meet in one row, which the digest of a conversation asks for anyway; nothing else is
grouped. Cases: null roles and texts are empty; very long texts are rendered whole; turns that tie are ordered by role, then text; repeated rows are turns
of their own; rows with a null conversation id are one conversation; an empty table gives no rows; columns other than
the four named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), r"([<\[])(\||/?s>|/?INST\])", r"$1\\$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, example from 0, formatted, loss_start, loss_chars): the span is in code points of formatted, from 0."""
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("conv_id", F.struct("turn", "role", "text", F.concat(F.lit("<s>"), escape(F.col("role")), F.lit("<|>")).alias("head"), escape(F.col("text")).alias("body")).alias("t"))
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    replies = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == ASSISTANT)
    ends = F.when((F.size("ends") > 0) & (F.element_at("ends", -1) == F.size("turns")), F.col("ends")).otherwise(F.array_append("ends", F.size("turns")))
    each = talks.withColumn("ends", replies).withColumn("ends", ends).select("conv_id", "turns", F.posexplode("ends").alias("example", "upto"))
    whole = lambda ts: F.array_join(F.transform(ts, lambda t: F.concat(t["head"], t["body"], F.lit("</s>\n"))), "")
    last = F.element_at("turns", F.col("upto"))
    trained = last["role"] == ASSISTANT
    each = each.select("conv_id", "example", whole(F.slice("turns", F.lit(1), F.col("upto") - 1)).alias("context"), F.concat(last["head"], last["body"], F.lit("</s>\n")).alias("target"), F.length(last["head"]).alias("head"), F.when(trained, F.length(last["body"])).otherwise(0).alias("loss_chars"))
    return each.select("conv_id", "example", F.concat("context", "target").alias("formatted"), (F.length("context") + F.col("head")).cast("long").alias("loss_start"), F.col("loss_chars").cast("long").alias("loss_chars"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    parts = F.filter(F.split(formatted, "</s>\n", -1), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(4)), "<|>", 1)).alias("role"), unescape(F.substring_index(p, "<|>", -1)).alias("text")))


def conversation_digest(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold: its turns as the longest example shows them, and the text under the loss mask."""
    loss = unescape(F.substr(F.col("formatted"), (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int")))
    talks = (
        examples.select("conv_id", "example", "formatted", F.when(F.col("loss_chars") > 0, loss).otherwise("").alias("loss"))
        .groupBy("conv_id")
        .agg(parse(F.max_by("formatted", "example")).alias("turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"), F.sum(F.length("formatted")).alias("formatted_chars"))
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return talks.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")

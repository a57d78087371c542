r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes its own example: all turns before it as context,
and only that reply under the loss mask.  Turns after the last reply make one
more example without a mask, so that no turn is lost.  A turn is rendered as
``<s>[INST] role [/INST]text</s>``; control strings inside roles and texts get
a backslash after their first character (one more if some are there), which
:func:`unescape` takes back.

Edge cases: null roles and texts are empty strings; turns are ordered by
(turn, role, text), null turns first; repeated turns are kept; a null conv_id
is a conversation of its own; an empty table gives no examples.  Only the four
named columns are read, so others may have any name.  A conversation is put
together in one row, and each of its examples repeats the turns before: n
replies of m characters take about n * n * m / 2 characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)(/?)(s>|INST\])", r"$1\\$2$3$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)(/?)(s>|INST\])", "$1$2$3$4")


def expand(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, example_no, n_turns, formatted, loss_start, loss_length): offsets in characters, length 0 without a reply."""
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    rendered = grouped.select(
        "conv_id",
        F.transform("ts", lambda t: F.struct(
            (t["role"] == ASSISTANT).alias("reply"),
            F.concat(F.lit("<s>[INST] "), escape(t["role"]), F.lit(" [/INST]")).alias("head"), escape(t["text"]).alias("body"),
        )).alias("ts"),
    )
    n = F.size("ts")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("ts", i)["reply"] | (i == n))
    each = rendered.select("conv_id", "ts", F.posexplode(ends).alias("example_no", "n_turns"))
    formatted = F.array_join(F.transform(F.slice("ts", 1, F.col("n_turns")), lambda t: F.concat(t["head"], t["body"], F.lit("</s>"))), "")
    last = F.element_at("ts", F.col("n_turns"))
    return each.withColumn("formatted", formatted).select(
        "conv_id", "example_no", "n_turns", "formatted",
        (F.length("formatted") - F.length(last["body"]) - 4).alias("loss_start"),
        F.when(last["reply"], F.length(last["body"])).otherwise(0).alias("loss_length"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the formatted strings alone: turns, loss text and total length."""
    segments = F.transform(
        F.slice(F.split("formatted", "</s>", -1), 1, F.col("n_turns")),
        lambda s: F.struct(
            unescape(F.regexp_extract(s, r"(?s)^<s>\[INST\] (.*?) \[/INST\](.*)$", 1)).alias("role"),
            unescape(F.regexp_extract(s, r"(?s)^<s>\[INST\] (.*?) \[/INST\](.*)$", 2)).alias("text"),
        ),
    )
    loss = unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length")))
    each = examples.select("conv_id", "example_no", "n_turns", segments.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("chars"))
    per = each.groupBy("conv_id").agg(
        F.max_by("turns", "n_turns").alias("turns"), F.sort_array(F.collect_list(F.struct("example_no", "loss"))).alias("losses"), F.sum("chars").alias("formatted_chars"),
    )
    return per.select("conv_id", "turns", F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")

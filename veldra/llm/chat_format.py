r"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role become one block; blocks are
concatenated to

    <turn:ROLE>text<next>text</turn>\n

where ``<next>`` stands between the merged turns of a block, so that every turn can be read back. Inside roles and texts
``\`` is written ``\\``, ``<`` is written ``\[`` and ``>`` is written ``\]``: a text can't hold a control string, and the
writing is reversible. The loss mask covers the texts of assistant turns, without the control strings around them.

Defined cases: null texts and roles are empty; turns that tie are ordered by role, then text; repeated rows stay; rows
with a null conversation id form one conversation, as GROUP BY has it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SHUT, NEXT, END = "<turn:", ">", "<next>", "</turn>\n"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\[")), F.lit(">"), F.lit("\\]"))


def unescaped(c: Column) -> Column:
    """The inverse: pairs of backslashes are set apart first, from the left, so each other one begins an escape."""
    parts = F.split(c, r"\\\\")
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\["), F.lit("<")), F.lit("\\]"), F.lit(">")))
    return F.array_join(plain, "\\")


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, segments array<struct<text, loss>>, formatted): formatted is the segments' texts in a row."""
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    # a block begins where the role is another than before; its turns are a slice
    places = F.transform("ts", lambda t, i: F.when((i == 0) | (F.get("ts", i - 1)["role"] != t["role"]), i + 1))
    begun = sorted_turns.select("conv_id", "ts", F.filter(places, lambda i: i.isNotNull()).alias("begins"))
    until = lambda i: F.coalesce(F.get("begins", i + 1), F.size("ts") + 1)
    merged = F.transform("begins", lambda b, i: F.struct(F.get("ts", b - 1)["role"].alias("role"), F.transform(F.slice("ts", b, until(i) - b), lambda t: t["text"]).alias("texts")))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def written(block: Column) -> Column:
        learn = block["role"] == trained_role
        text = lambda t, i: F.array(segment(F.when(i == 0, F.lit("")).otherwise(F.lit(NEXT)), F.lit(False)), segment(escaped(t), learn))
        head, tail = F.concat(F.lit(OPEN), escaped(block["role"]), F.lit(SHUT)), F.lit(END)
        return F.concat(F.array(segment(head, F.lit(False))), F.flatten(F.transform(block["texts"], text)), F.array(segment(tail, F.lit(False))))

    blocks = begun.select("conv_id", merged.alias("blocks"))
    return blocks.select("conv_id", F.flatten(F.transform("blocks", written)).alias("segments")).withColumn(
        "formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, learned array<string>), from formatted and segments alone."""
    # each block begins with OPEN, which no escaped text can hold
    blocks = F.filter(F.split("formatted", OPEN), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = unescaped(F.substring_index(b, SHUT, 1))
        body = F.substring(b, F.instr(b, SHUT) + 1, F.length(b))
        body = F.substring(body, F.lit(1), F.length(body) - len(END))
        return F.transform(F.split(body, NEXT), lambda x: F.struct(role.alias("role"), unescaped(x).alias("text")))

    learned = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"]))
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns)).alias("turns"), learned.alias("learned"))

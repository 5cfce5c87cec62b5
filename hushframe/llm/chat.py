"""Chat formatting with Spark expressions only.

A conversation's rows are collected and sorted by turn; adjacent turns of one role share a block; blocks
are put together by array functions. Texts are escaped so that no control string can come from
a text, and the loss mask is a list of character spans of the formatted text that holds each assistant text
once. Everything can be read back from the formatted text and the spans.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings of a template. Each starts with `<|`, which escaped texts never contain.

    A backslash is doubled, and one is put behind the first character of whatever matches `control`.
    """

    turn: str = "<|turn|>"
    body: str = "<|body|>"
    also: str = "<|also|>"
    end: str = "<|end|>"
    control: str = r"<(?=\|)|<(?=/?s>)|<(?=</?SYS>>)|\[(?=/?INST\])"
    learned: tuple[str, ...] = ("assistant",)

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({self.control})", r"$1\\")

    @staticmethod
    def unescape(text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _bound(value: Column, f) -> Column:
    """Give a value to a function through a lambda variable, so that it is computed once."""
    return F.transform(F.array(value), f)[0]


def format_chats(rows: DataFrame, template: Template | None = None, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, loss_spans (array of start and length in code points), n_turns, n_blocks.

    Rows are sorted by turn, nulls first, and ties by role and text; a null role or text is empty, and repeated
    rows stay separate turns. Rows with a null conversation id make one conversation. An empty table gives no rows;
    other columns are not read. A conversation is one output value, so its rows meet in one task.
    """
    t = template or Template()
    source = rows.select(rows[f"`{conv}`"].alias("conv_id"), F.struct(rows[f"`{turn}`"].alias("turn"), F.coalesce(rows[f"`{role}`"], F.lit("")).alias("role"), F.coalesce(rows[f"`{text}`"], F.lit("")).alias("text")).alias("row"))
    collected = source.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))

    def parts(turns: Column) -> Column:
        """For each turn what stands before its text, and its text."""

        def part(x: Column, i: Column) -> Column:
            same = (i > 0) & (x["role"] == turns[F.greatest(i - 1, F.lit(0))]["role"])
            head = F.concat(F.when(i > 0, F.lit(t.end)).otherwise(F.lit("")), F.lit(t.turn), t.escape(x["role"]), F.lit(t.body))
            return F.struct(F.when(same, F.lit(t.also)).otherwise(head).alias("head"), t.escape(x["text"]).alias("text"), x["role"].isin(*t.learned).alias("loss"), (~same).cast("int").alias("block"))

        return F.transform(turns, part)

    def spans(found: Column) -> Column:
        kind = "array<struct<start:int,length:int>>"
        start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {kind})").alias("spans"))

        def add(acc: Column, x: Column) -> Column:
            begin, size = acc["at"] + F.length(x["head"]), F.length(x["text"])
            one = F.array(F.struct(begin.alias("start"), size.alias("length")))
            return F.struct((begin + size).alias("at"), F.when(x["loss"], F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(found, start, add, lambda acc: acc["spans"])

    made = collected.select("conv_id", F.size("turns").cast("long").alias("n_turns"), _bound(F.col("turns"), parts).alias("parts"))
    whole = F.concat(F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["text"])), ""), F.lit(t.end))
    return made.select("conv_id", whole.alias("formatted"), spans(F.col("parts")).alias("loss_spans"), "n_turns", F.aggregate("parts", F.lit(0), lambda a, x: a + x["block"]).alias("n_blocks"))


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """The turns (array of role and text) that a formatted text holds."""
    t = template or Template()

    def block(b: Column) -> Column:
        sides = F.split(b, re.escape(t.body), 2)
        role = t.unescape(F.substring(sides[0], len(t.turn) + 1, 1 << 30))
        return F.transform(F.split(sides[1], re.escape(t.also)), lambda x: F.struct(role.alias("role"), t.unescape(x).alias("text")))

    blocks = F.split(formatted, re.escape(t.end))
    return F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), block))


def read_loss(formatted: Column, spans: Column, template: Template | None = None) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    t = template or Template()
    return F.transform(spans, lambda s: t.unescape(F.substring(formatted, s["start"] + 1, s["length"])))

"""Preference examples from pairs of conversations, in DataFrame functions only.

The longest common prefix of turns of a chosen and a rejected conversation is rendered once
as the prompt; what follows in each is its completion. A completion's mask names the
characters that count for training: the texts and ends of its assistant turns.

Defined results: turns are in order of turn, then role, then text, and repeated rows are
turns of their own; null roles and texts render as empty and equal each other; turns without
a conversation id belong to no conversation; a conversation without partner, or a pair whose
conversation has no turns, gets an empty conversation as the other; equal conversations have
empty completions; empty tables give no rows. Extra columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): one row per conversation, the example that is rendered as one text."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    listed = turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(END))


def text_of(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def trained_spans(turns: Column) -> Column:
    """(start, end) in code points of the completion for each assistant turn: its text and end mark."""
    empty = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("spans"))

    def step(done: Column, turn: Column) -> Column:
        end = done["at"] + F.length(rendered(turn))
        span = F.struct((done["at"] + F.length(turn["role"]) + len(START) + len(MIDDLE)).alias("start"), end.alias("end"))
        spans = F.when(turn["role"] == TRAINED, F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, empty, step, lambda done: done["spans"])


def preference_examples(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each (pair_id, chosen_id, rejected_id).

    Adds ``common_turns``, ``prompt``, and for both sides the completion and its mask, an
    array of (start, end).
    """
    whole = conversations(turns)
    sides = {
        side: whole.select(F.col("conv_id").alias(f"{side}_id"), F.col("turns").alias(f"{side}_turns")) for side in ("chosen", "rejected")
    }
    both = pairs.select("pair_id", "chosen_id", "rejected_id")
    none = F.expr("CAST(array() AS array<struct<role:string,text:string>>)")
    for side, frame in sides.items():
        both = both.join(frame, f"{side}_id", "left").withColumn(f"{side}_turns", F.coalesce(f"{side}_turns", none))
    equal = F.zip_with("chosen_turns", "rejected_turns", lambda a, b: a.eqNullSafe(b))
    apart = F.array_position(equal, F.lit(False))
    common = F.when(apart > 0, apart - 1).otherwise(F.size("chosen_turns")).cast("int")
    split = both.withColumn("common_turns", common)
    rest = {s: F.slice(f"{s}_turns", F.col("common_turns") + 1, F.size(f"{s}_turns")) for s in sides}
    split = split.select(
        "pair_id", "chosen_id", "rejected_id", "common_turns", "chosen_turns", *[rest[s].alias(f"{s}_rest") for s in sides]
    )
    return split.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        "common_turns",
        text_of(F.slice("chosen_turns", F.lit(1), F.col("common_turns"))).alias("prompt"),
        *[text_of(F.col(f"{s}_rest")).alias(s) for s in sides],
        *[trained_spans(F.col(f"{s}_rest")).alias(f"{s}_mask") for s in sides],
    )


def neighbours(turns: DataFrame) -> DataFrame:
    """Pairs of conversations with neighbouring ids: the even one as chosen, the odd one as rejected.

    For tables without preferences. Every conversation is in one pair; its partner may not exist.
    """
    half = F.shiftright(F.col("conv_id").cast("long"), 1)
    numbers = turns.where("conv_id IS NOT NULL").select(half.alias("pair_id")).distinct()
    return numbers.select("pair_id", (2 * F.col("pair_id")).alias("chosen_id"), (2 * F.col("pair_id") + 1).alias("rejected_id"))

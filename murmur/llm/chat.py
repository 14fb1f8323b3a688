"""Chat formatting with perspective rotation.

Every participant of a conversation gets a rendering of it in which that
speaker is the assistant, all others are named users and system turns stay
system turns; the loss mask covers the assistant's texts and their end marks.

Turns get their place (number and character offset) from distributed prefix
sums, so a conversation of any length is spread over many tasks.  A rendering
comes in parts of ``PART_TURNS`` turns: part 0 is all there is of usual
conversations, and a conversation without end is many rows of bounded length.

Defined cases: a null role is the speaker ``unknown``, a null text is empty,
a null turn comes first; turns that tie go by role and text, repeated turns
are all rendered; null conversation ids are one conversation; a conversation
of system turns only has no participant and gives no rows; marks that occur
in a text or role are broken up by a space.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import prefix_sums

PART_TURNS = 1_000
SYSTEM, UNKNOWN = "system", "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _safe(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        _safe(F.coalesce(F.col(role_col).cast("string"), F.lit(UNKNOWN))).alias("role"),
        _safe(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))


def rotate_perspectives(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                        role_col: str = "role", text_col: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """(conv, speaker, part, n_turns, n_target_turns, text, mask) per participant and part.

    ``mask`` holds [start, end) character offsets into the part's text.
    """
    turns = _turns(conversations, conv_col, turn_col, role_col, text_col).withColumn("one", F.lit(1))
    placed = prefix_sums(turns, ["conv"], [F.col("turn"), F.col("role"), F.col("text")], ["one"], "chat-turns")
    speakers = (turns.filter(F.col("role") != SYSTEM).select(F.col("conv").alias("_conv"), F.col("role").alias("speaker"))
                .distinct())
    seen = placed.join(speakers, F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")
    target = F.col("role") == F.col("speaker")
    head = (F.when(target, F.lit(f"{OPEN}assistant\n"))
            .when(F.col("role") == SYSTEM, F.lit(f"{OPEN}system\n"))
            .otherwise(F.concat(F.lit(f"{OPEN}user name="), F.col("role"), F.lit("\n"))))
    turn = F.struct(F.col("one_before").alias("at"), target.alias("target"), head.alias("head"),
                    F.concat("text", F.lit(CLOSE)).alias("body"))
    part = (F.col("one_before") / part_turns).cast("long")
    parts = (seen.groupBy("conv", "speaker", part.alias("part"))
             .agg(F.sort_array(F.collect_list(turn)).alias("turns")))               # part_turns at most
    step = lambda acc, t: F.struct(
        (acc["end"] + F.char_length(t["head"]) + F.char_length(t["body"]) + 1).alias("end"),
        F.when(t["target"], F.concat(acc["mask"], F.array(F.struct(
            (acc["end"] + F.char_length(t["head"])).alias("start"),
            (acc["end"] + F.char_length(t["head"]) + F.char_length(t["body"])).alias("end")))))
        .otherwise(acc["mask"]).alias("mask"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))
    return parts.select(
        "conv", "speaker", "part", F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("turns", lambda t: t["target"])).cast("long").alias("n_target_turns"),
        F.concat(F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"])), "\n"), F.lit("\n")).alias("text"),
        F.aggregate("turns", start, step, lambda acc: acc["mask"]).alias("mask"))

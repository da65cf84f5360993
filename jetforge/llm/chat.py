"""Chat formatting by perspective rotation: the dialogue once for every participant.

Seen by one participant, their turns are the assistant's and carry the loss, everyone else is a
named user, and system turns stay what they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, stored

SEGMENT_TURNS = 64  # a longer dialogue is rendered in pieces that follow one another
SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _plain(text: Column) -> Column:
    """Text in which nothing can pass for a control mark."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def ranked_turns(turns: DataFrame) -> DataFrame:
    """Rank of each turn in its conversation, from 0, by turn (null first), speaker and text.

    The table is cut into ranges of conversation and turn, so that one conversation can lie in many
    partitions; a row's rank is its place among its conversation's rows in the partition, plus the
    conversation's rows in earlier ones.
    """
    order = ["_conv", "_turn", "_role", "_text"]
    laid = stored(turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id()), "turns")
    laid = laid.withColumn("_part", F.shiftright("_n", 33))
    parts = laid.groupBy("_conv", "_part").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("_conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(parts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))), "turn-parts").drop("_rows")
    parts = parts.withColumnsRenamed({"_conv": "_c", "_part": "_p"})
    met = laid.join(parts, F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_part") == F.col("_p")))
    return met.select(*order, (F.col("_n") - F.col("_first") + F.col("_before")).alias("_rank"))


def rotate(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """One row per conversation, participant and segment: conv_id, speaker, segment, n_turns,
    n_assistant, text and mask.

    A participant is a role other than system. The segments of a dialogue, in order, make up the
    whole of it; a dialogue of at most ``segment_turns`` turns has one. ``mask`` lists the spans of
    ``text`` that carry the loss (a turn of the speaker with its end mark), as start:end in
    characters, comma-joined. Turns are gathered by segment, never by conversation; the output has
    each turn once for every participant, which is what is asked for.

    A null text is an empty turn. A turn without a role is an unnamed user's and has no perspective
    of its own; a conversation of system turns alone has none. Rows without a conversation form one
    together. Repeated rows are repeated turns; an empty table gives none. "<|" in texts and names
    is written "< |". Other columns are ignored.
    """
    rows = conversations.select(quoted(conv_col).alias("_conv"), quoted(turn_col).alias("_turn"), quoted(role_col).cast("string").alias("_role"),
                                quoted(text_col).cast("string").alias("_text"))
    speakers = stored(rows.where(F.col("_role").isNotNull() & (F.col("_role") != SYSTEM)).select("_conv", "_role").distinct(), "speakers")
    segment = F.floor(F.col("_rank") / segment_turns).alias("segment")
    gathered = ranked_turns(rows).groupBy("_conv", segment).agg(
        F.array_sort(F.collect_list(F.struct("_rank", F.col("_role").alias("role"), _plain(F.col("_text")).alias("text")))).alias("turns"))
    gathered = stored(gathered, "segments")
    seen = gathered.join(speakers.withColumnsRenamed({"_conv": "_c", "_role": "speaker"}), F.col("_conv").eqNullSafe(F.col("_c")))

    def head(turn: Column) -> Column:
        name = F.coalesce(F.concat(F.lit("user name="), _plain(turn["role"])), F.lit("user"))
        role = F.when(turn["role"] == F.col("speaker"), "assistant").when(turn["role"] == SYSTEM, SYSTEM).otherwise(name)
        return F.concat(F.lit(OPEN), role, F.lit("\n"))

    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(CLOSE)).alias("body"),
                                                     F.coalesce(t["role"] == F.col("speaker"), F.lit(False)).alias("own")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, piece: Column) -> Column:
        begin = state["at"] + F.length(piece["head"])
        end = begin + F.length(piece["body"])
        span = F.array(F.concat_ws(":", begin.cast("string"), end.cast("string")))
        return F.struct(end.alias("at"), F.when(piece["own"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    out = seen.withColumn("pieces", pieces).withColumn("spans", F.aggregate("pieces", start, step)["spans"])
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "")
    return out.select(F.col("_conv").alias("conv_id"), "speaker", "segment", F.size("turns").cast("long").alias("n_turns"),
                      F.size("spans").cast("long").alias("n_assistant"), text.alias("text"), F.array_join("spans", ",").alias("mask"))

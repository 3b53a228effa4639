"""Chat formatting with cumulative-snapshot collapse.

Chat logs often hold a conversation once for each turn that was added. A rolling hash over the turns gives each prefix
of a conversation a key; a conversation whose whole key is a proper prefix of a longer one is dropped by an anti-join,
and of equal ones the first stays. What remains is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

#: The marks of the ChatML format.
BEGIN, END = "<|im_start|>", "<|im_end|>"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), role, text, h1, h2: hashes of all turns up to this one.

    Turns are ordered by turn, role and text, nulls first; rows that repeat all three are one turn. Null roles and
    texts count as empty. Turns without conv_id belong to no conversation and are left out.
    """
    turns = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    same = F.col("turn").eqNullSafe(F.lag("turn").over(order)) & (F.col("role") == F.lag("role").over(order)) & (F.col("text") == F.lag("text").over(order))
    turns = turns.withColumn("again", F.coalesce(same, F.lit(False))).filter("NOT again").drop("again")
    turns = turns.withColumn("pos", F.row_number().over(order))
    # each turn's hash has its place in it, so that the running XOR is a hash of the sequence
    return turns.withColumns({f"h{k}": F.bit_xor(F.xxhash64(F.lit(k), "pos", "role", F.length("role"), "text")).over(order.rowsBetween(Window.unboundedPreceding, 0)) for k in (1, 2)})


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that are no proper prefix of another, the first of equal ones."""
    last = F.max("pos").over(Window.partitionBy("conv_id"))
    keys = turns.select("conv_id", "pos", "h1", "h2", (F.col("pos") < last).alias("goes_on"))
    # both sides are reduced to distinct keys before they meet, so that a common opening or conversation is one row
    whole = keys.filter("NOT goes_on").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    longer = keys.filter("goes_on").select("pos", "h1", "h2").distinct()
    return whole.join(longer, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").cast("long").alias("n_turns"), "n_copies")


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per conversation that stays: conv_id, n_turns, n_copies, rendered.

    n_copies counts the conversations equal to it, itself included; see ordered_turns for order, nulls and repeats.
    """
    turns = materialize(ordered_turns(conversations), "turns")
    stay = collapse(turns)
    line = F.concat(F.lit(BEGIN), F.col("role"), F.lit("\n"), F.col("text"), F.lit(END), F.lit("\n"))
    rendered = (
        turns.join(stay.select("conv_id"), "conv_id", "left_semi")
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
        .select("conv_id", F.array_join(F.col("lines.line"), "").alias("rendered"))
    )
    return stay.join(rendered, "conv_id").select("conv_id", "n_turns", "n_copies", "rendered")

"""Exact dedup by a heavy-hitter split.

Misra-Gries summaries find the digests that may hold more than 1/(counters+1) of all rows. Their groups are counted
exactly; these verified winners are at most `counters` rows, so they are broadcast and their copies are settled where
they are read. All other groups are smaller than that share, so an ordinary shuffle by digest spreads evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, few, fresh, materialize, text_or_empty

COUNTERS = 1024
#: Rows in a block that is counted exactly before the first cut (as a power of two).
BLOCK_BITS = 16
#: Summaries are merged into so many, then fewer, then one: none gathers more than some 10^5 counters.
FANS = (4096, 64, 1)


def text_digest(text: str = "text") -> Column:
    """SHA-256 of the text with each run of white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(text_or_empty(text), SPACE, " "), 256)


def _cut(summary: DataFrame, key: str, counters: int) -> DataFrame:
    """The Misra-Gries cut: keeps the largest `counters` counts, less the first count left out."""
    by_count = Window.partitionBy("block").orderBy(F.desc("n"), key)
    ranked = summary.withColumn("rank", F.row_number().over(by_count))
    left_out = F.max(F.when(F.col("rank") == counters + 1, F.col("n"))).over(Window.partitionBy("block"))
    return (
        ranked.withColumn("n", F.col("n") - F.coalesce(left_out, F.lit(0)))
        .filter((F.col("rank") <= counters) & (F.col("n") > 0))
        .select("block", key, "n")
    )


def misra_gries(rows: DataFrame, key: str, counters: int = COUNTERS) -> DataFrame:
    """(key, n): at most `counters` keys, among them each with over rows/(counters+1) rows; n is a lower bound.

    Blocks of rows are counted, cut, then merged by adding counts and cutting again, which keeps the guarantee.
    """
    block = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)
    summary = rows.select(block.alias("block"), key).groupBy("block", key).agg(F.count("*").alias("n"))
    summary = _cut(summary, key, counters)
    for fan in FANS:
        summary = (
            summary.withColumn("block", F.pmod(F.xxhash64("block"), F.lit(fan)))
            .groupBy("block", key)
            .agg(F.sum("n").alias("n"))
        )
        summary = _cut(summary, key, counters)
    return summary.select(key, "n")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Of rows with equal text the one with the smallest id stays. Null text counts as empty; a null id comes after all
    others; of rows that repeat id and text one stays. No rows give no rows; other columns of
    docs are not looked at.
    """
    rows = materialize(
        docs.select(F.col(id_col).alias("id"), F.unhex(text_digest(text_col)).alias("digest"))
        .withColumn("row", F.monotonically_increasing_id()),
        "digests",
    )
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))).alias("first")
    size = F.count("*").alias("group_size")
    found = misra_gries(rows, "digest", counters).select("digest")
    winners = materialize(
        rows.join(F.broadcast(found), "digest").groupBy("digest").agg(first, size).filter("group_size > 1"), "winners"
    )
    frequent = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").repartition("digest")
    settled = rest.join(rest.groupBy("digest").agg(first, size), "digest")
    return frequent.unionByName(settled).select(
        F.col("id").alias(id_col),
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns; of rows that repeat id and text one.

    What goes is named by a key of id and digest, and what stays more than once too. These keys are written before they
    meet the texts again: texts are shuffled only if the keys are too many to be broadcast, and to find one of repeated rows.
    """
    (key,) = fresh(docs, "_key")
    of = lambda i, sha: F.unhex(F.sha2(F.concat(i.isNull().cast("string"), F.coalesce(i.cast("string"), F.lit("")), sha), 256))
    settled = exact_dedup(docs, id_col, text_col)
    keys = settled.groupBy(of(F.col(id_col), F.col("text_sha256")).alias(key)).agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    odd = materialize(keys.filter("NOT stays OR n > 1").select(key, "stays"), "copies")
    marked = docs.withColumn(key, of(F.col(id_col), text_digest(text_col)))
    left = marked.join(few(odd.select(key)), key, "left_anti")
    again = odd.filter("stays").select(key)
    if not again.isEmpty():
        left = left.unionByName(marked.join(few(again), key, "left_semi").dropDuplicates([key]))
    return left.drop(key)

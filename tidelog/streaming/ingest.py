"""Streams of messages and accesses: commits per micro-batch, running frequencies, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import log as L
from ..operators.policy import MigrationPolicy


def commit_stream(messages: DataFrame, path: str, checkpoint: str, period: str | None = None) -> StreamingQuery:
    """Writes each micro-batch of a log stream as one generation: path/gen=<batch>.

    A batch that runs again overwrites its own generation, so each message is committed once. Without a period what is
    there is committed and the query ends.
    """

    def commit(batch: DataFrame, number: int) -> None:
        batch.withColumn("gen", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/gen={number}")

    writer = messages.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=period) if period else writer.trigger(availableNow=True)).start()


def read_commits(spark, path: str, upto: int | None = None) -> DataFrame:
    """The committed log, up to a generation."""
    rows = spark.read.schema(L.LOG_SCHEMA).parquet(path)
    return rows if upto is None else rows.filter(F.col("gen") <= upto)


def frequency_stream(accesses: DataFrame) -> DataFrame:
    """(object_id, freq, last_tier): running counts; rows that change are sent on in update mode."""
    return accesses.groupBy("object_id").agg(F.count("*").alias("freq"), F.max_by("tier", "seq").alias("last_tier"))


def windowed_frequency(accesses: DataFrame, width: str, late: str) -> DataFrame:
    """(window, object_id, freq) by event time `ts`; accesses later than `late` are no longer counted."""
    return accesses.withWatermark("ts", late).groupBy(F.window("ts", width), "object_id").agg(F.count("*").alias("freq"))


def compact_commits(spark, path: str, upto: int, out: str) -> None:
    """Writes the generations up to one as a single compacted log."""
    L.compact(read_commits(spark, path, upto)).write.mode("overwrite").parquet(out)


def policy_stream(accesses: DataFrame, policy: MigrationPolicy, tiers: DataFrame, path: str, checkpoint: str, threshold: float = 0.95) -> StreamingQuery:
    """Runs a policy over each micro-batch of accesses (object_id, tier, seq, size): path/turn=<batch> holds its moves.

    The frequencies within a batch decide, as a turn of the policy looks at what has happened since the last one.
    tiers: tier, free, total. A batch that runs again overwrites its own turn.
    """

    def turn(batch: DataFrame, number: int) -> None:
        objects = batch.groupBy("object_id").agg(F.count("*").alias("freq"), F.max_by("tier", "seq").alias("tier"), F.max("size").alias("size"))
        policy.moves(objects, tiers, threshold).write.mode("overwrite").parquet(f"{path}/turn={number}")

    return accesses.writeStream.foreachBatch(turn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_latest(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the rows that each micro-batch of an aggregated stream has changed as path/batch=<number>, in update mode."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark, path: str, *keys: str) -> DataFrame:
    """Of what keep_latest has written, the newest row of each key."""
    rows = spark.read.parquet(path)
    own = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*own), "batch").alias("_r")).select(*keys, *[f"_r.{c}" for c in own])

"""Key-value workloads as plans: a table of operations (seq, id, dice 0..99) over a table of records (id, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges

#: Ids of a bucket when scans meet records.
SCAN_BUCKET = 128


def zipf_rank(u: Column, n: int, theta: float = 0.99) -> Column:
    """The rank, from 1 to n, that a number u of [0, 1) draws: the usual closed form for Zipf's distribution."""
    zeta, alpha, eta, second = zipf_constants(n, theta)
    rest = F.lit(1) + F.floor(n * F.pow(eta * u - eta + 1, F.lit(alpha)))
    return F.when(u * zeta < 1, 1).when(u * zeta < second, 2).otherwise(F.least(rest, F.lit(n))).cast("long")


def zipf_constants(n: int, theta: float) -> tuple[float, float, float, float]:
    zeta = sum(1 / i**theta for i in range(1, n + 1))
    second = 1 + 0.5**theta
    return zeta, 1 / (1 - theta), (1 - (2 / n) ** (1 - theta)) / (1 - second / zeta), second


def _so_far(ops: DataFrame, own: Column) -> DataFrame:
    """ops with `before`, the sum of own over all operations up to each."""
    return ranges.sum_ahead(ops, own, [F.asc("seq")]).withColumn("before", F.col("before") + own)


def reads(records: DataFrame, ops: DataFrame) -> DataFrame:
    """(seq, id, value): what each operation reads."""
    return ops.join(records, "id", "left").select("seq", "id", "value")


def mixed(records: DataFrame, ops: DataFrame, read_percent: int) -> DataFrame:
    """(seq, id, value) of the reads among ops, the others being updates of present records to "v<seq>".

    Records, updates and reads of an id are lined up by seq, so each read sees the last update before it.
    """
    base = records.select("id", F.lit(-1).cast("long").alias("seq"), "value", F.lit(False).alias("asks"))
    updates = ops.filter(F.col("dice") >= read_percent).join(records.select("id"), "id", "left_semi").select("id", "seq", F.concat(F.lit("v"), F.col("seq").cast("string")).alias("value"), F.lit(False).alias("asks"))
    asked = ops.filter(F.col("dice") < read_percent).select("id", "seq", F.lit(None).cast("string").alias("value"), F.lit(True).alias("asks"))
    w = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = base.unionByName(updates).unionByName(asked)
    return rows.withColumn("value", F.last("value", ignorenulls=True).over(w)).filter("asks").select("seq", "id", "value")


def latest_reads(records: DataFrame, ops: DataFrame, read_percent: int) -> DataFrame:
    """(seq, id): reads of recent records while others are inserted: the id is the newest one less id % 10.

    How many inserts came before a read is a running count, see _so_far.
    """
    size = F.broadcast(records.agg(F.count("*").alias("size")))
    rows = _so_far(ops, F.when(F.col("dice") >= read_percent, 1).otherwise(0)).crossJoin(size)
    live = F.col("size") + F.col("before")
    return rows.filter(F.col("dice") < read_percent).select("seq", F.greatest(live - F.col("id") % 10, F.lit(1)).alias("id"))


def _bucket(c: Column) -> Column:
    return F.floor(c / SCAN_BUCKET)


def reached_buckets(scans: DataFrame) -> DataFrame:
    """(low, high, bucket): the different ranges of scans, once for each bucket of ids that they reach."""
    wanted = scans.filter("high > low").select("low", "high").distinct()
    return wanted.withColumn("bucket", F.explode(F.sequence(_bucket(F.col("low")), _bucket(F.col("high") - 1))))


def scans(records: DataFrame, ops: DataFrame, read_percent: int) -> DataFrame:
    """(seq, n, first, last): scans of seq % 100 + 1 ids from an id, while the other operations insert "v<seq>" after the largest id.

    A scan sees what was inserted before it. Inserted ids grow with seq, so that is its range up to the last such id: a
    running count, taken only for scans that reach beyond the records. Then a range has one answer, whoever asks: each
    different one meets the records of its buckets once, and a bucket has few of them, however many scans begin in it.
    """
    high = F.col("id") + F.col("seq") % 100 + 1
    top = F.broadcast(records.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")))
    rows = ops.select("seq", F.col("id").alias("low"), high.alias("high"), (F.col("dice") >= read_percent).alias("inserts")).crossJoin(top)
    beyond = F.coalesce(F.col("high") > F.col("top") + 1, F.lit(False))
    # at one seq scans come before inserts, which they do not see
    counted = ranges.sum_ahead(rows.filter(F.col("inserts") | beyond), F.col("inserts").cast("long"), [F.asc("seq"), F.asc("inserts")])
    newest = F.col("top") + F.col("before")
    new = counted.filter("inserts").select((newest + 1).alias("id"), F.concat(F.lit("v"), F.col("seq").cast("string")).alias("value"))
    clipped = counted.filter("NOT inserts").select("seq", "low", F.least(F.col("high"), newest + 1).alias("high"))
    asked = rows.filter(~F.col("inserts") & ~beyond).select("seq", "low", "high").unionByName(clipped)
    stored = records.select("id", "value").unionByName(new).withColumn("bucket", _bucket(F.col("id")))
    met = reached_buckets(asked).join(stored, "bucket").filter((F.col("id") >= F.col("low")) & (F.col("id") < F.col("high")))
    found = met.groupBy("low", "high").agg(F.count("id").alias("n"), F.min("value").alias("first"), F.max("id").alias("last"))
    seen = asked.join(found, ["low", "high"], "left")
    return seen.groupBy("seq").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def read_modify_write(records: DataFrame, ops: DataFrame, read_percent: int) -> DataFrame:
    """(id, value) after all operations that read a record and write it back with "+<seq>" behind."""
    writes = ops.filter(F.col("dice") >= read_percent).groupBy("id").agg(F.array_sort(F.collect_list("seq")).alias("seqs"))
    added = F.array_join(F.transform("seqs", lambda s: F.concat(F.lit("+"), s.cast("string"))), "")
    return records.join(writes, "id", "left").select("id", F.concat("value", F.coalesce(added, F.lit(""))).alias("value"))


def scaling(runs: DataFrame) -> DataFrame:
    """runs (threads, n, ns) with operations per second and what they would be if all threads did as well as one."""
    ops = F.col("n") / (F.col("ns") / 1e9)
    w = Window.orderBy("threads")  # a row per number of threads
    rows = runs.withColumn("ops", ops)
    return rows.withColumn("optimal", F.first("ops").over(w) / F.first("threads").over(w) * F.col("threads"))

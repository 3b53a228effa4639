"""Space: allocations by tier and disk, free runs, fragmentation, caches, devices, replicas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges


def signed(op: Column, n: Column) -> Column:
    """Blocks that an allocation takes from the free ones; a release gives them back."""
    return F.when(op == 1, -n).otherwise(n)


def free_space(log: DataFrame, capacity: DataFrame, *by: str) -> DataFrame:
    """capacity (by..., total) with `free` after all allocations of the log."""
    used = log.groupBy(*by).agg(F.sum(signed(F.col("op"), F.col("n"))).alias("change"))
    return capacity.join(used, list(by), "left").select(*by, "total", (F.col("total") + F.coalesce("change", F.lit(0))).cast("long").alias("free"))


def running_space(log: DataFrame, *by: str) -> DataFrame:
    """log with `change`, the blocks given back less those taken up to each row."""
    own = signed(F.col("op"), F.col("n"))
    rows = ranges.sum_ahead(log, own, [F.asc("time")], *by, name="change")
    return rows.withColumn("change", F.col("change") + F.coalesce(own, F.lit(0)))


def bitmap(log: DataFrame, *by: str) -> DataFrame:
    """(by..., block, op): the last thing that happened to each block; filter the log by time for an earlier state."""
    rows = log.select(*by, "time", "op", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("n") - 1)).alias("block"))
    return rows.groupBy(*by, "block").agg(F.max_by("op", "time").alias("op"))


def free_runs(state: DataFrame, blocks: int, *by: str) -> DataFrame:
    """(by..., start, length): the runs of free blocks of each segment of so many blocks.

    Runs are what lies between used blocks, so free blocks need no rows.
    """
    w = Window.partitionBy(*by).orderBy("block")
    used = state.filter("op = 1").select(*by, "block")
    gaps = used.select(*by, (F.coalesce(F.lag("block").over(w), F.lit(-1)) + 1).alias("start"), F.col("block").alias("end"))
    tails = used.groupBy(*by).agg((F.max("block") + 1).alias("start")).select(*by, "start", F.lit(blocks).alias("end"))
    empty = state.groupBy(*by).agg(F.max("op").alias("op")).filter("op = 0").select(*by, F.lit(0).alias("start"), F.lit(blocks).alias("end"))
    return gaps.unionByName(tails).unionByName(empty).filter("end > start").select(*by, "start", (F.col("end") - F.col("start")).alias("length"))


def fragmentation(runs: DataFrame, *by: str) -> DataFrame:
    """(by..., total_free, largest_free, fragmentation): 1 - largest / total, 0 without free blocks."""
    rows = runs.groupBy(*by).agg(F.sum("length").alias("total_free"), F.max("length").alias("largest_free"))
    return rows.withColumn("fragmentation", F.coalesce(1 - F.try_divide(F.col("largest_free"), F.col("total_free")), F.lit(0.0)))


def first_fit(runs: DataFrame, need: Column, *by: str) -> DataFrame:
    """(by..., start): where the first run long enough begins."""
    return runs.filter(F.col("length") >= need).groupBy(*by).agg(F.min("start").alias("start"))


def last_known(points: DataFrame, asked: DataFrame, time: str, value: str, *by: str) -> DataFrame:
    """asked (by..., time) with the last value at or before each time.

    Both are lined up by time, so no row meets more than its predecessor.
    """
    a = asked.select(*by, time, F.lit(1).alias("asks"), F.lit(None).cast(points.schema[value].dataType).alias(value))
    b = points.select(*by, time, F.lit(0).alias("asks"), value)
    rows = ranges.last_known(a.unionByName(b), F.col(value), [F.asc(time), F.asc("asks")], *by, name=value)
    return rows.filter("asks = 1").drop("asks")


def choose_class(requests: DataFrame, strategy: DataFrame, free: DataFrame) -> DataFrame:
    """requests (id, pref, need) with the first class of the preference's strategy that has enough free space.

    strategy: pref, classes (array); free: class, free. Both have four rows at most.
    """
    ranked = F.broadcast(strategy.select("pref", F.posexplode("classes").alias("pos", "class")).join(free, "class"))
    rows = requests.join(ranked, "pref", "left").groupBy("id").agg(F.min_by("class", F.when(F.col("free") >= F.col("need"), F.col("pos"))).alias("class"))
    return rows


def choose_disk(disks: DataFrame, *by: str) -> DataFrame:
    """The disk with most free space of each group, the smallest id of equal ones."""
    best = F.max(F.struct("free", (-F.col("disk")).alias("d"))).alias("best")
    return disks.groupBy(*by).agg(best).select(*by, (-F.col("best.d")).alias("disk"), F.col("best.free").alias("free"))


def cache_ratios(counters: DataFrame) -> DataFrame:
    """counters (hits, misses, size, entries, ...) with hit_percent and mean entry size."""
    return counters.withColumns({"hit_percent": F.try_divide(100.0 * F.col("hits"), F.col("hits") + F.col("misses")), "entry_size": F.try_divide(F.col("size").cast("double"), F.col("entries"))})


def choose_replica(replicas: DataFrame) -> DataFrame:
    """The first healthy replica of each block and how many others need repair: replicas are (block, replica, ok)."""
    return replicas.groupBy("block").agg(F.min(F.when(F.col("ok"), F.col("replica"))).alias("replica"), F.count_if(~F.col("ok")).alias("faulted"), F.when(F.max(F.col("ok").cast("int")) == 1, F.count_if(~F.col("ok"))).otherwise(0).cast("long").alias("repaired"))


def parity(columns: DataFrame, *by: str) -> DataFrame:
    """The XOR of the data columns of each stripe."""
    return columns.groupBy(*by).agg(F.bit_xor("value").alias("parity"))

"""Running figures over orders too long for one task: rows are cut into ranges of the order, and only one row per range meets the others."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNBOUNDED = Window.unboundedPreceding


def folder(spark: SparkSession) -> str:
    """A new folder that the driver and executors share."""
    shared, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not shared:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="tidelog-")
    return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}/query-{uuid.uuid4().hex}"


def _ranged(df: DataFrame, order: list[Column], *by: str) -> DataFrame:
    """df with _part, the number of the range of (by, order) that each row falls in.

    The ranges are written down: they come from a sample, and whoever cut the rows again could cut them elsewhere.
    """
    path = folder(df.sparkSession)
    df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _after_starts(ranged: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows and, ahead of those of each range, one row of starts that brings what the ranges before it come to."""
    return ranged.withColumn("_is_row", F.lit(True)).unionByName(starts.withColumn("_is_row", F.lit(False)), allowMissingColumns=True)


def sum_ahead(df: DataFrame, own: Column, order: list[Column], *by: str, name: str = "before") -> DataFrame:
    """df with the sum of `own` over the rows of the same group ahead of each in an order, 0 for the first.

    Null groups are groups, and nulls of own add nothing. Rows that the order holds equal count in any order.
    """
    ranged = _ranged(df.withColumn("_own", F.coalesce(own, F.lit(0))), order, *by)
    earlier = F.sum("_sum").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(UNBOUNDED, -1))
    starts = ranged.groupBy(*by, "_part").agg(F.sum("_own").alias("_sum")).select(*by, "_part", F.coalesce(earlier, F.lit(0)).alias("_own"))
    w = Window.partitionBy(*by, "_part").orderBy("_is_row", *order).rowsBetween(UNBOUNDED, -1)
    return _after_starts(ranged, starts).withColumn(name, F.sum("_own").over(w)).filter("_is_row").drop("_part", "_own", "_is_row")


def last_known(df: DataFrame, value: Column, order: list[Column], *by: str, name: str) -> DataFrame:
    """df with the last value that is not null in the rows of the same group up to each, itself included; null before any."""
    ranged = _ranged(df.withColumn("_own", value), order, *by)
    place = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    newest = F.max_by("_own", F.when(F.col("_own").isNotNull(), F.col("_place"))).alias("_last")
    earlier = F.last("_last", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_part").rowsBetween(UNBOUNDED, -1))
    starts = ranged.withColumn("_place", place).groupBy(*by, "_part").agg(newest).select(*by, "_part", earlier.alias("_own"))
    w = Window.partitionBy(*by, "_part").orderBy("_is_row", *order).rowsBetween(UNBOUNDED, 0)
    return _after_starts(ranged, starts).withColumn(name, F.last("_own", ignorenulls=True).over(w)).filter("_is_row").drop("_part", "_own", "_is_row")

"""Telemetry: differences of counters, ratios, interval merges, flattening, buckets, trends, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Upper bounds of the size buckets; sizes beyond the last but one share the last.
SIZE_BUCKETS = [64_000, 256_000, 1_000_000, 4_000_000, 1_000_000_000]
BLOCK = 4096


def diff(c: str, w: Window) -> Column:
    """A counter less its last value; the first less 0."""
    return F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))


def diff_zero_first(c: str, w: Window) -> Column:
    return F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0))


def since_first(c: str, *by: str) -> Column:
    return F.col(c) - F.min(c).over(Window.partitionBy(*by))


def hit_ratio(hits: str, misses: str, w: Window) -> Column:
    """Percent of hits since the last sample, null if nothing was asked."""
    h, m = diff_zero_first(hits, w), diff_zero_first(misses, w)
    return F.try_divide(100.0 * h, h + m)


def throughput(blocks: str, w: Window, interval_ms: int = 500) -> Column:
    """MiB per second of a counter of blocks that is sampled so often."""
    return diff_zero_first(blocks, w) * BLOCK / 1024 / 1024 * 1000 / interval_ms


def moving_average(c: str, n: int, w: Window) -> Column:
    """The mean of the last n values, of fewer at the start."""
    return F.avg(c).over(w.rowsBetween(1 - n, 0))


def interval_merge(primary: DataFrame, secondary: DataFrame, time: str, *by: str) -> DataFrame:
    """secondary with `start`: the primary time whose interval, up to the next one, it falls in.

    What comes before the first or from the last primary time on is left out. Times are lined up in one window per
    group instead of joined by range.
    """
    marks = primary.select(*by, time).distinct()
    end = F.max(time).over(Window.partitionBy(*by))
    marks = marks.withColumn("_last", end)
    null = {c: F.lit(None).cast(secondary.schema[c].dataType) for c in secondary.columns if c not in (*by, time)}
    a = marks.select(*by, time, "_last", F.lit(0).alias("_side"), *[v.alias(c) for c, v in null.items()])
    b = secondary.select(*by, time, F.lit(None).cast(marks.schema[time].dataType).alias("_last"), F.lit(1).alias("_side"), *null)
    w = Window.partitionBy(*by).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.last(F.when(F.col("_side") == 0, F.col(time)), ignorenulls=True).over(w)
    rows = a.unionByName(b).withColumns({"start": mark, "_last": F.last("_last", ignorenulls=True).over(w)})
    return rows.filter((F.col("_side") == 1) & F.col("start").isNotNull() & (F.col("start") < F.col("_last"))).drop("_side", "_last")


def merge_maps(left: Column, right: Column, time: str) -> Column:
    """Two string maps as one, the right one's values first but for its time."""
    rest = F.map_filter(right, lambda k, _: k != time)
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(rest, k)), rest)


def flatten(df: DataFrame, sep: str = "_", fixed: dict[str, int] | None = None) -> DataFrame:
    """Nested columns as flat ones named by their path; arrays to so many places as `fixed` names for their path."""
    fixed = fixed or {}

    def walk(column: Column, kind: T.DataType, path: str) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [x for f in kind for x in walk(column[f.name], f.dataType, f"{path}{sep}{f.name}" if path else f.name)]
        if isinstance(kind, T.ArrayType) and path in fixed:
            return [x for i in range(fixed[path]) for x in walk(F.get(column, i), kind.elementType, f"{path}{sep}{i}")]
        return [column.alias(path)]

    return df.select([x for f in df.schema for x in walk(F.col(f"`{f.name}`"), f.dataType, f.name)])


def size_bucket(size: Column) -> Column:
    bucket = F.lit(SIZE_BUCKETS[-1])
    for bound in SIZE_BUCKETS[-2::-1]:
        bucket = F.when(size <= bound, bound).otherwise(bucket)
    return bucket


def box(c: str) -> list[Column]:
    """Least, quartiles and largest."""
    return [F.min(c).alias("least"), F.percentile(c, F.lit(0.25)).alias("q1"), F.percentile(c, F.lit(0.5)).alias("median"), F.percentile(c, F.lit(0.75)).alias("q3"), F.max(c).alias("most")]


def trend(df: DataFrame, y: str, x: str, *by: str) -> DataFrame:
    """The least-squares line of y over x for each group."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def histogram(df: DataFrame, c: str, *by: str) -> DataFrame:
    return df.groupBy(*by, c).agg(F.count("*").alias("n"))


def ecdf(df: DataFrame, c: str, *by: str) -> DataFrame:
    """(by..., c, n, share): how many rows have each value and what share has it or a smaller one."""
    w = Window.partitionBy(*by)
    rows = histogram(df, c, *by)
    up_to = F.sum("n").over(w.orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("share", up_to / F.sum("n").over(w))

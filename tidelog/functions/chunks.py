"""Chunk arithmetic of objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 131_072
#: Greatest end of a byte range; ends beyond it saturate.
MOST = 2**63 - 1


def div(c: Column, by: int | Column) -> Column:
    """Integer division, truncated."""
    return F.call_function("div", c.cast("long"), (F.lit(by) if isinstance(by, int) else by).cast("long"))


def chunk_of(offset: Column, size: int = CHUNK) -> Column:
    return div(offset, size)


def in_chunk(offset: Column, size: int = CHUNK) -> Column:
    return offset % size


def range_end(offset: Column, length: Column) -> Column:
    return F.when(length > F.lit(MOST) - offset, F.lit(MOST)).otherwise(offset + length)


def chunk_count(offset: Column, length: Column, size: int = CHUNK) -> Column:
    """How many chunks a byte range touches."""
    last = div(range_end(offset, length) - 1, size)
    return F.when(length > 0, last - div(offset, size) + 1).otherwise(F.lit(0)).cast("long")


def chunk_split(offset: Column, length: Column, size: int = CHUNK) -> Column:
    """array<struct<chunk_id, begin, end>>: a byte range cut at chunk bounds, places within the chunk.

    An empty range gives an empty array (a descending sequence would not be empty).
    """
    end = range_end(offset, length)
    first, last = div(offset, size), div(end - 1, size)
    part = lambda c: F.struct(c.alias("chunk_id"), (F.greatest(offset, c * size) - c * size).alias("begin"), (F.least(end, c * size + size) - c * size).alias("end"))
    none = F.array().cast("array<struct<chunk_id:bigint,begin:bigint,end:bigint>>")
    return F.when(length > 0, F.transform(F.sequence(first, last), part)).otherwise(none)

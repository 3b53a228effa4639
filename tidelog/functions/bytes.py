"""Byte strings as columns: keys are big-endian, so that their byte order is the order of their numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def be_encode(c: Column, width: int = 8) -> Column:
    """A number as so many big-endian bytes."""
    return F.unhex(F.substring(F.lpad(F.hex(c.cast("long")), 16, "0"), 17 - 2 * width, 2 * width))


def be_decode(c: Column) -> Column:
    """The unsigned number in up to seven big-endian bytes, or the signed one in eight."""
    return F.conv(F.hex(c), 16, -10).cast("long")


def slice_bytes(c: Column, start: int | Column, length: int | Column | None = None) -> Column:
    """`length` bytes from `start` (from 0), or all that follow."""
    start = F.lit(start) if isinstance(start, int) else start
    length = F.length(c) if length is None else F.lit(length) if isinstance(length, int) else length
    return F.substring(c, start + 1, length)


def zero_extend(c: Column, length: Column) -> Column:
    """c with zero bytes up to a length; a longer c stays."""
    return F.call_function("rpad", c, F.greatest(F.length(c), length).cast("int"), F.unhex(F.lit("00")))


def overlay_at(c: Column, offset: Column, data: Column) -> Column:
    """c with data written over it at an offset; a gap before it is zero bytes; null c counts as empty."""
    whole = zero_extend(F.coalesce(c, F.unhex(F.lit(""))), (offset + F.length(data)).cast("int"))
    return F.overlay(whole, data, offset + 1, F.length(data))


def contains_nul(c: Column) -> Column:
    return F.call_function("position", F.unhex(F.lit("00")), c) > 0


def meta_key(key: Column, name: Column) -> Column:
    """Key of a custom metadata entry: object key, zero byte, name."""
    return F.concat(key, F.unhex(F.lit("00")), name)


def meta_bounds(key: Column) -> tuple[Column, Column]:
    """The half-open range of an object's custom metadata keys."""
    return F.concat(key, F.unhex(F.lit("00"))), F.concat(key, F.unhex(F.lit("01")))


def prefix_bounds(prefix: Column) -> tuple[Column, Column]:
    """The half-open range in which keys with a prefix are looked for."""
    return prefix, F.concat(prefix, F.unhex(F.lit("FF")))


def size_label(c: Column) -> Column:
    """Bytes as "4.0MB" or "64.0KB", in powers of ten."""
    return F.when(c >= 1_000_000, F.concat(F.round(c / 1_000_000, 1).cast("string"), F.lit("MB"))).otherwise(F.concat(F.round(c / 1000, 1).cast("string"), F.lit("KB")))


def ms_label(c: Column) -> Column:
    """Milliseconds as m:ss."""
    seconds = F.floor(c / 1000).cast("long")
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("long"), seconds % 60)

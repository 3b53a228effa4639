"""Binary allocation logs: a header that describes the storage, then records of 29 bytes."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import storage

# Fixed values of the format: little-endian operation, offset, blocks, cycles of the allocation and in all.
RECORD = np.dtype([("op", "u1"), ("offset", "<u8"), ("blocks", "<u4"), ("own", "<u8"), ("total", "<u8")])
SCHEMA = "path string, time bigint, op int, disk_offset bigint, num_blocks bigint, cycles_alloc bigint, cycles_total bigint"


def header_size(data: bytes) -> int:
    """Bytes of the header: a count of classes, each with a count of disks, each disk with its segments and blocks."""
    at = 1
    for _ in range(data[0]):
        (disks,) = struct.unpack_from("<H", data, at)
        at += 2 + 16 * disks
    return at


def _little(c: Column, width: int) -> Column:
    """A number as so many little-endian bytes."""
    digits = F.lpad(F.hex(c.cast("long")), max(16, 2 * width), "0")
    return F.unhex(F.concat(*[F.substring(digits, max(16, 2 * width) - 2 * i - 1, 2) for i in range(width)]))


def records(data: bytes, at_a_time: int = 50_000) -> Iterator[np.ndarray]:
    """The whole records of a log, so many at a time: a view of its bytes."""
    start = header_size(data) if data else 0
    n = (len(data) - start) // RECORD.itemsize
    for at in range(0, n, at_a_time):
        yield np.frombuffer(data, RECORD, min(at_a_time, n - at), start + at * RECORD.itemsize)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the logs under path: SCHEMA. time is a record's place in its log."""

    def decode(batches):
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                if name.endswith(".txt"):
                    data = b"\0" + b"".join(base64.b64decode(line) for line in data.split())
                time = 0
                for r in records(data):
                    columns = {"path": name, "time": np.arange(time, time + len(r)), "op": r["op"].astype(np.int32), "disk_offset": r["offset"].astype(np.int64), "num_blocks": r["blocks"].astype(np.int64), "cycles_alloc": r["own"].astype(np.int64), "cycles_total": r["total"].astype(np.int64)}
                    yield pd.DataFrame(columns)
                    time += len(r)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, SCHEMA)


def write(log: DataFrame, path: str) -> None:
    """Writes op, disk_offset and num_blocks as logs with an empty header, one file a partition.

    Each log goes out as lines of base64 that `read` takes too: Spark has no sink for bare bytes.
    """
    record = F.concat(_little(F.col("op"), 1), _little(F.col("disk_offset"), 8), _little(F.col("num_blocks"), 4), _little(F.lit(0), 16))
    log.select(F.base64(record).alias("value")).write.text(path)


def placed(log: DataFrame) -> DataFrame:
    """log with tier, disk, segment and begin (the place in the segment) of each record."""
    o: Column = F.col("disk_offset")
    segment = F.shiftrightunsigned(storage.offset_block(o), 18)
    return log.withColumns({"tier": storage.offset_tier(o), "disk": storage.offset_disk(o), "segment": segment, "begin": storage.in_segment(o)})

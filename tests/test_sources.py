import struct

import pytest
from pyspark.sql import functions as F

from tidelog.functions import storage
from tidelog.operators import telemetry
from tidelog.sources import alloclog, config, files


def test_allocation_log(spark, tmp_path):
    header = bytes([2]) + struct.pack("<H", 1) + bytes(16) + struct.pack("<H", 2) + bytes(32)
    offset = 2 << 62 | 5 << 52 | (3 << 18) + 17
    body = b"".join(struct.pack("<BQLQQ", op, offset + op, 4, 7, 9) for op in (1, 0))
    (tmp_path / "log").write_bytes(header + body + b"\1\2")
    (tmp_path / "empty").write_bytes(b"")
    rows = alloclog.placed(alloclog.read(spark, f"file://{tmp_path}")).orderBy("time").collect()
    assert [(r.time, r.op, r.tier, r.disk, r.segment, r.begin, r.num_blocks, r.cycles_total) for r in rows] == [(0, 1, 2, 5, 3, 18, 4, 9), (1, 0, 2, 5, 3, 17, 4, 9)]


def test_text_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 3)], files.MEASUREMENTS["ycsb"])
    files.write_csv(df, f"file://{tmp_path}/csv")
    assert files.read_csv(spark, f"file://{tmp_path}/csv", "ycsb").collect() == df.collect()
    metrics = spark.createDataFrame([(5, None, None, [(1, 2), (3, 4)])], files.METRICS)
    files.write_jsonl(metrics, f"file://{tmp_path}/json")
    flat = telemetry.flatten(files.read_jsonl(spark, f"file://{tmp_path}/json"), fixed={"usage": 2}).first()
    assert (flat.epoch_ms, flat.usage_0_free, flat.usage_1_total) == (5, 1, 4)


def test_config():
    env = {"TIDELOG__A__B": "3", "TIDELOG__A__C": "x", "OTHER": "1"}
    assert config.merge({"a": {"b": 1, "d": 2}}, config.from_env(env)) == {"a": {"b": 3, "c": "x", "d": 2}}
    text = "/dev/a mirror /dev/b /dev/c parity /dev/d /dev/e /dev/f"
    assert config.format_layout(config.parse_layout(text)) == text
    with pytest.raises(ValueError):
        config.parse_layout("parity /dev/a /dev/b")


def test_offsets_use_the_sign_bit(spark):
    row = spark.range(1).select(storage.pack_offset(F.lit(3), F.lit(1023), F.lit(9)).alias("o")).select("o", storage.offset_tier(F.col("o")).alias("t"), storage.offset_disk(F.col("o")).alias("d"), storage.offset_block(F.col("o")).alias("b")).first()
    assert row.o < 0 and (row.t, row.d, row.b) == (3, 1023, 9)

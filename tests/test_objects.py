"""Writes of bytes against byte arrays, and how few rows they are cut into."""

import random
import time

import pytest
from pyspark.sql import functions as F
from tidelog.operators import log as L
from tidelog.operators import objects as O

WRITES = "object_id bigint, seq bigint, offset bigint, data binary"


def random_writes(seed, n, most):
    rng = random.Random(seed)
    return [(rng.randrange(3), seq, rng.randrange(most), bytearray(rng.randbytes(rng.randrange(most)))) for seq in range(n)]


@pytest.mark.parametrize(("seed", "size", "most"), [(0, 1024, 5000), (1, 100, 300), (2, 1, 20), (3, 131_072, 200_000)])
def test_writes_are_laid_over_each_other(spark, seed, size, most):
    rows, want = random_writes(seed, 40, most), {}
    for i, _, offset, data in rows:
        v = want.setdefault(i, bytearray())
        v.extend(bytes(max(0, offset + len(data) - len(v))))
        v[offset : offset + len(data)] = data
    writes = spark.createDataFrame(rows, WRITES)
    read = O.read_at(O.grown_sizes(writes), O.apply_writes(writes, size), 7, most, size)
    assert {r.object_id: bytes(r.data) for r in read.collect()} == {i: bytes(v[7 : 7 + most]) for i, v in want.items()}


def test_a_write_is_few_runs(spark):
    """A write that covers chunks in part is a few runs, not a row for each of its bytes."""
    rows, size = random_writes(4, 200, 4000), 1024
    cut = spark.createDataFrame(rows, WRITES).select("seq", F.explode(L.runs(F.col("offset"), F.col("data"), size)).alias("c")).select("seq", "c.*").collect()
    places = {(r.block, r.begin, r.n) for r in cut}
    for _, seq, offset, data in rows:
        own = sorted((r for r in cut if r.seq == seq), key=lambda r: (r.block, r.begin))
        assert b"".join(bytes(r.bytes) for r in own) == bytes(data)
        assert len(own) <= 4 * 10 + len(data) // size
        at = offset
        for r in own:
            assert r.block * size + r.begin == at and r.begin % r.n == 0 and len(r.bytes) == r.n
            at += r.n
    assert all(sum(p[0] == b for p in places) < 2 * size for b in range(9))


@pytest.mark.parametrize(("offset", "length", "size"), [(0, 1, 1024), (700, 900, 1024), (1024, 1024, 1024), (90, 2000, 100), (4900, 300, 1024), (9000, 50, 1024)])
def test_reads_lay_only_what_they_ask(spark, offset, length, size):
    rows, want = random_writes(5, 60, 5000), {}
    for i, _, at, data in rows:
        v = want.setdefault(i, bytearray())
        v.extend(bytes(max(0, at + len(data) - len(v))))
        v[at : at + len(data)] = data
    writes = spark.createDataFrame([*rows, (0, 60, 0, None), (1, 61, None, bytearray(b"x"))], WRITES)
    read = {r.object_id: bytes(r.data) for r in O.read_written(writes, offset, length, size).collect()}
    assert read == {i: bytes(v[offset : offset + length]) for i, v in want.items()}
    laid = O.apply_writes(writes, size, offset, offset + length).agg(F.min("chunk_id"), F.max("chunk_id")).first()
    assert laid[0] is None or laid[0] >= offset // size and laid[1] <= (offset + length - 1) // size


def test_a_long_write_costs_its_length(spark):
    """A write of 16 MiB is cut into 16384 blocks; each was a copy of the whole write."""
    n = 16 << 20
    write = spark.range(1).select(F.repeat(F.lit("0123456789abcdef"), n // 16).cast("binary").alias("data"))
    began = time.time()
    found = write.select(F.explode(L.runs(F.lit(0).cast("long"), F.col("data"), 1024)).alias("c")).agg(F.count("*"), F.sum(F.length("c.bytes"))).first()
    assert tuple(found) == (n // 1024, n)
    assert time.time() - began < 20

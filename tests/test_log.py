"""The log against a plain model: a dict of byte arrays."""

import random

import pytest
from tidelog.operators import log as L


def model(messages):
    values = {}
    for key, _, _, op, offset, data, nbits, bit in sorted(messages, key=lambda m: m[1]):
        key = bytes(key)
        if op == "I":
            values[key] = bytearray(data)
        elif op == "D":
            values.pop(key, None)
        elif op == "U":
            v = values.setdefault(key, bytearray())
            v.extend(bytes(max(0, offset + len(data) - len(v))))
            v[offset : offset + len(data)] = data
        else:
            v = values.setdefault(key, bytearray())
            v.extend(bytes(max(0, -(-(offset + nbits) // 8) - len(v))))
            for p in range(offset, offset + nbits):
                v[p // 8] = v[p // 8] | 1 << p % 8 if bit else v[p // 8] & ~(1 << p % 8)
    return {bytes(k): bytes(v) for k, v in values.items()}


def random_messages(seed, n, bits):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        op = rng.choice("IDUUB" if bits else "IDUU")
        data = bytes(rng.randrange(256) for _ in range(rng.randrange(0 if op == "U" else 1, 6)))
        if op in "DB":
            data = b""
        rows.append((bytearray([rng.randrange(1, 12)]), seq, seq // 20, op, rng.randrange(12) if op in "UB" else 0, bytearray(data), rng.randrange(0, 14) if op == "B" else None, rng.random() < 0.5 if op == "B" else None))
    return rows


def resolved(df):
    return {bytes(r.key): bytes(r.value) for r in df.collect()}


@pytest.mark.parametrize(("seed", "block"), [(0, 4096), (1, 4), (2, 3), (3, 1)])
def test_resolve_is_the_model(spark, seed, block):
    """Values of some bytes, in one block and in many."""
    rows = random_messages(seed, 150, bits=True)
    assert resolved(L.resolve(spark.createDataFrame(rows, L.LOG_SCHEMA), block)) == model(rows)


def test_large_values_of_many_messages(spark):
    """Values of up to the largest size: inserts of 512 KiB, upserts of some bytes, of several blocks and far behind the end."""
    rng, rows = random.Random(1), []
    data = lambda n: bytearray(rng.randbytes(n))
    for seq in range(60):
        key = bytearray([1 + seq % 3])
        if seq < 2 or seq == 40:
            rows.append((key, seq, 0, "I", 0, data(L.MOST_BYTES), None, None))
        else:
            n = rng.choice([1, 7, 4096, 20_000, 131_072])
            rows.append((key, seq, 0, "U", rng.choice([0, 4096, 8192, rng.randrange(L.MOST_BYTES - n)]), data(n), None, None))
    rows.append((bytearray(b"z"), 61, 0, "U", 400_000, data(5), None, None))
    assert resolved(L.resolve(spark.createDataFrame(rows, L.LOG_SCHEMA))) == model(rows)


def test_fold_compaction_and_merge_agree(spark):
    rows = random_messages(7, 150, bits=False)
    log = spark.createDataFrame(rows, L.LOG_SCHEMA)
    want = model(rows)
    assert resolved(L.resolve_by_fold(log)) == want
    assert resolved(L.resolve(L.compact(log))) == want
    assert resolved(L.merge_scan(L.resolve(log.filter("gen < 4")), log.filter("gen >= 4"))) == want
    assert resolved(L.resolve(L.as_of(log, 3))) == model([r for r in rows if r[2] <= 3])


def test_range_delete_and_recreate(spark):
    rows = random_messages(3, 80, bits=False)
    log = L.range_delete(spark.createDataFrame(rows, L.LOG_SCHEMA), b"\3", b"\7", 1000, 9)
    want = {k: v for k, v in model(rows).items() if not b"\3" <= k < b"\7"}
    assert resolved(L.resolve(log)) == want
    again = spark.createDataFrame([(bytearray([4]), 1001, 10, "U", 2, bytearray(b"x"), None, None)], L.LOG_SCHEMA)
    assert resolved(L.resolve(log.unionByName(again))) == want | {b"\4": b"\0\0x"}


def test_ranges_and_limits(spark):
    rows = random_messages(5, 60, bits=False)
    values = L.resolve(spark.createDataFrame(rows, L.LOG_SCHEMA))
    want = model(rows)
    assert resolved(L.key_range(values, b"\3", b"\5")) == {k: v for k, v in want.items() if b"\3" <= k < b"\5"}
    assert resolved(L.key_range(values, b"\3", b"\5", True, False)) == {k: v for k, v in want.items() if b"\3" < k <= b"\5"}
    for low, high in ((b"\5", b"\5"), (b"\5", b"\3")):
        with pytest.raises(ValueError, match="invalid range"):
            L.key_range(values, low, high)
    for bad in ((bytearray(), 1, 0, "I", 0, bytearray(b"x"), None, None), (bytearray(b"k"), 1, 0, "U", L.MOST_BYTES, bytearray(b"x"), None, None)):
        with pytest.raises(Exception, match="empty key|too large"):
            L.checked(spark.createDataFrame([bad], L.LOG_SCHEMA)).collect()


def test_empty_log(spark):
    assert L.resolve(spark.createDataFrame([], L.LOG_SCHEMA)).count() == 0

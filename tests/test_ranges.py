"""Running figures by ranges against plain loops: one group holds most rows, one has no name, values tie and are missing."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import ranges

SCHEMA = "g int, t long, k long, v long"


@pytest.fixture(scope="module", autouse=True)
def small_ranges(spark):
    """Small tables would come in one range otherwise."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    groups = [0] * 300 + [1] * 40 + [None] * 20 + [2]
    return [(g, rng.choice([None, *range(9)]), i, rng.choice([None, 1, 2, 3])) for i, g in enumerate(rng.sample(groups, len(groups)))]


def in_order(rows, g):
    """Nulls come first, as in an ascending order."""
    return sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))


def test_sums_ahead(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = ranges.sum_ahead(df, F.col("v"), [F.asc("t"), F.asc("k")], "g").collect()
    want = set()
    for g in (0, 1, 2, None):
        so_far = 0
        for r in in_order(rows, g):
            want.add((*r, so_far))
            so_far += r[3] or 0
    assert len(got) == len(rows) and {tuple(r) for r in got} == want


def test_sums_ahead_downwards_and_without_groups(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {r.k: r.n for r in ranges.sum_ahead(df, F.lit(1), [F.desc("k")], name="n").collect()}
    assert got == {k: len(rows) - 1 - k for k in range(len(rows))}


def test_last_known(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = ranges.last_known(df, F.when(F.col("k") % 50 == 7, F.struct("k", "v")), [F.asc("t"), F.asc("k")], "g", name="x").collect()
    want = set()
    for g in (0, 1, 2, None):
        last = None
        for r in in_order(rows, g):
            last = (r[2], r[3]) if r[2] % 50 == 7 else last
            want.add((*r, last))
    assert len(got) == len(rows) and {(*r[:4], r.x and tuple(r.x)) for r in got} == want


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ranges.sum_ahead(df, F.col("v"), [F.asc("k")], "g").collect() == []
    assert ranges.last_known(df, F.col("v"), [F.asc("k")], name="x").collect() == []


def test_ranges_split_a_large_group(spark):
    df = spark.range(4000).withColumn("g", F.lit(1)).repartition(5)
    assert ranges._ranged(df, [F.asc("id")], "g").select("_part").distinct().count() == 4

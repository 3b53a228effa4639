"""Scans against plain loops."""

import random

from tidelog.operators import workload as W


def test_scans_are_the_loop(spark):
    """Scans over records and over what was inserted before them, equal numbers and no id included."""
    rng = random.Random(5)
    records = [(i, f"n{rng.randrange(1000)}") for i in range(1, 301) if rng.random() < 0.8] + [(301, "z")]
    ops = [(seq, rng.choice([1, 1, 5, 120, 290, 301, 310, 330, 500, None]), rng.randrange(100)) for seq in range(400)]
    ops = [(s, i, d if d < 70 else 99) for s, i, d in ops]
    want, stored = {}, [(i, v, -1) for i, v in records]
    for k, seq in enumerate(s for s, _, d in ops if d >= 95):
        stored.append((302 + k, f"v{seq}", seq))
    for seq, low, dice in ops:
        if dice < 95:
            own = [(i, v) for i, v, born in stored if low is not None and low <= i < low + seq % 100 + 1 and born < seq]
            want[seq] = (len(own), min((v for _, v in own), default=None), max((i for i, _ in own), default=None))
    found = W.scans(spark.createDataFrame(records, "id long, value string"), spark.createDataFrame(ops, "seq long, id long, dice long"), 95).collect()
    assert len(found) == len(want) and {r.seq: (r.n, r.first, r.last) for r in found} == want


def test_equal_ranges_meet_records_once(spark):
    asked = spark.range(20_000).selectExpr("id AS seq", "120L AS low", "120L + id % 10 AS high")
    assert W.reached_buckets(asked).count() == 10

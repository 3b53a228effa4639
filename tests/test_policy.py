"""Sequential policies against plain loops."""

import math
import random

import numpy as np

from tidelog.operators import policy as P


def test_reuse_cache_is_a_plain_loop(spark):
    rng = random.Random(1)
    trace = [rng.randrange(8) for _ in range(300)]
    last, hits, evictions = {}, 0, 0
    for i, k in enumerate(trace):
        hits += k in last and i - last[k] <= 5
        evictions += k in last and i - last[k] > 5
        last[k] = i
    got = P.reuse_cache(spark.createDataFrame([(0, i, k) for i, k in enumerate(trace)], "part long, seq long, key long"), 5).first()
    assert (got.hits, got.misses, got.evictions) == (hits, 300 - hits, evictions)


def test_td_learning(spark):
    a, b, p, lam, beta = [1.0, 2.0, 3.0], [0.5, 0.1, 0.2], [0.1] * 8, 0.8, 0.05
    steps = [(0, i, 0.1 * i, 1.0 * i, 0.5 + i, 0.3 * i) for i in range(6)]

    def phi(s):
        large = [1 / (1 + x * math.exp(-y * v)) for x, y, v in zip(a, b, s, strict=True)]
        w = [u * v * x for u in (1 - large[0], large[0]) for v in (1 - large[1], large[1]) for x in (1 - large[2], large[2])]
        return np.array(w) / sum(w)

    own, z, seen = np.array(p), np.zeros(8), [np.zeros(8)]
    for now, after in zip(steps, steps[1:], strict=False):
        f, g = phi(now[2:5]), phi(after[2:5])
        alpha = 0.1 / (1 + 100 * sum(seen[:-1], np.zeros(8)))
        decay = math.exp(-beta * now[4])
        z = lam * decay * z + f
        own = own + alpha * (now[5] + decay * own @ g - own @ f) * z
        seen.append(g)
    got = P.td_learn(spark.createDataFrame(steps, "tier int, step int, s1 double, s2 double, s3 double, reward double"), a, b, p, lam, beta).first()
    assert np.allclose(got.p, own)

"""Columns of the learned placement policy."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight of an object's last temperature.
ALPHA = 0.8
#: Decay of rewards.
BETA = 0.05
# Slopes and offsets of the memberships of the three parts of a state.
SLOPES = [7.33 / 0.3, 7.33 / 1500, 7.33 / 1]
OFFSETS = [math.exp(SLOPES[0] * 0.3), math.exp(SLOPES[1] * 1750), math.exp(SLOPES[2] * 0.5)]
#: State of a tier without objects: mean temperature, mean temperature by size, response time.
EMPTY = (0.0, 100000.0, 0.0)


def logistic(s: Column, a: float, b: float) -> Column:
    """How large a value is, between 0 and 1."""
    return 1 / (1 + a * F.exp(-b * s))


def fuzzy_weights(state: list[Column], a: list[float], b: list[float]) -> list[Column]:
    """The share of each of the eight rules: every state part as small, then as large, the first one outermost."""
    parts = [(1 - logistic(s, x, y), logistic(s, x, y)) for s, x, y in zip(state, a, b, strict=True)]
    weights = [x * y * z for x, y, z in product(*parts)]
    total = sum(weights[1:], weights[0])
    return [w / total for w in weights]


def fuzzy_cost(state: list[Column], a: list[float], b: list[float], p: list[float]) -> Column:
    terms = [w * v for w, v in zip(fuzzy_weights(state, a, b), p, strict=True)]
    return sum(terms[1:], terms[0])


def temperature(last: Column, since: Column, alpha: float = ALPHA) -> Column:
    return alpha * last + (1 - alpha) * since


def without(total: Column, n: Column, own: Column, empty: float) -> Column:
    """The mean of a group without one of its members; of no members, a given value."""
    return F.when(n > 1, (total - own) / (n - 1)).otherwise(F.lit(empty))


def joined_by(total: Column, n: Column, own: Column) -> Column:
    """The mean of a group that one more joins."""
    return (total + own) / (n + 1)

"""Placement policies: least-frequently-used promotion and demotion, thresholds, and the learned policy's state."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import learning
from . import ranges

#: Fixed values of the default policy: blocks promoted at a time, and how full a tier may be.
PROMOTE_BLOCKS, FULL = 1024, 0.95


def frequencies(accesses: DataFrame, *keep: str) -> DataFrame:
    """(object_id, freq, keep...): accesses of each object, and columns that are the same in all its rows."""
    return accesses.groupBy("object_id").agg(F.count("*").alias("freq"), *[F.max(c).alias(c) for c in keep])


def until_full(objects: DataFrame, limit: Column, order: list[Column], *by: str) -> DataFrame:
    """The first objects of each group, in an order, until their sizes reach a limit; the one that reaches it counts.

    before is the size of those ahead of each.
    """
    return ranges.sum_ahead(objects, F.col("size"), order, *by).filter(F.col("before") < limit)


def promote(objects: DataFrame, tight: DataFrame, desired: int = PROMOTE_BLOCKS) -> DataFrame:
    """Objects (object_id, tier, freq, size) that move one tier up: object_id, tier, target.

    The hottest of each lower tier go until their sizes reach `desired`. Into a tier that is tight (tier, tight) an
    object only goes if it is hotter than the coldest one there; the first that is not ends it, as those after it are
    colder still.
    """
    coldest = objects.groupBy("tier").agg(F.min("freq").alias("coldest")).select((F.col("tier") + 1).alias("tier"), "coldest")
    upper = F.broadcast(tight.select((F.col("tier") + 1).alias("tier"), "tight"))  # a row per tier
    rows = objects.filter("tier > 0").join(upper, "tier", "left").join(F.broadcast(coldest), "tier", "left")
    may = ~F.coalesce("tight", F.lit(False)) | (F.coalesce("coldest", F.lit(0)) < F.col("freq"))
    first = until_full(rows.filter(may), F.lit(desired), [F.desc("freq"), F.asc("object_id")], "tier")
    return first.select("object_id", "tier", (F.col("tier") - 1).alias("target"))


def demote(objects: DataFrame, desired: DataFrame) -> DataFrame:
    """Objects that move one tier down: the coldest of each tier until their sizes reach its desired blocks."""
    rows = objects.join(F.broadcast(desired), "tier")  # a row per tier
    first = until_full(rows, F.col("desired"), [F.asc("freq"), F.asc("object_id")], "tier")
    return first.select("object_id", "tier", (F.col("tier") + 1).alias("target"))


def threshold_plan(tiers: DataFrame, threshold: float = FULL) -> DataFrame:
    """tiers (tier, free, total) as pairs of a tier and the next: tight, demote, desired blocks."""
    w = Window.orderBy("tier")  # four tiers at most
    full = 1 - F.col("free") / F.col("total")
    rows = tiers.filter("total > 0").withColumn("full", full).withColumn("low_full", F.lead("full").over(w))
    desired = F.floor(F.round(F.col("total") * (1 - threshold), 6)).cast("long") - F.col("free")
    demotes = (F.col("full") > threshold) & (F.col("low_full") < threshold)
    return rows.filter("low_full IS NOT NULL").select("tier", (F.col("full") >= threshold).alias("tight"), demotes.alias("demote"), F.when(demotes, desired).otherwise(0).alias("desired"))


class MigrationPolicy(ABC):
    """Which objects move between tiers: the extension point of a policy loop, see streaming.ingest.policy_stream."""

    @abstractmethod
    def promote(self, objects: DataFrame, plan: DataFrame) -> DataFrame:
        """(object_id, tier, target) of objects (object_id, tier, freq, size) that move up; plan is a threshold_plan."""

    @abstractmethod
    def demote(self, objects: DataFrame, plan: DataFrame) -> DataFrame:
        """(object_id, tier, target) of objects that move down."""

    def moves(self, objects: DataFrame, tiers: DataFrame, threshold: float = FULL) -> DataFrame:
        """All moves of one turn: an object that would do both stays."""
        plan = threshold_plan(tiers, threshold)
        both = self.promote(objects, plan).unionByName(self.demote(objects, plan))
        return both.groupBy("object_id").agg(F.min("tier").alias("tier"), F.min("target").alias("target"), F.count("*").alias("n")).filter("n = 1").drop("n")


class LeastFrequentlyUsed(MigrationPolicy):
    """Promotes the most and demotes the least used objects."""

    def __init__(self, promote_blocks: int = PROMOTE_BLOCKS):
        self.promote_blocks = promote_blocks

    def promote(self, objects: DataFrame, plan: DataFrame) -> DataFrame:
        return promote(objects, plan.select("tier", "tight"), self.promote_blocks)

    def demote(self, objects: DataFrame, plan: DataFrame) -> DataFrame:
        return demote(objects, plan.filter("demote").select("tier", "desired"))


def tier_states(objects: DataFrame, requests: DataFrame) -> DataFrame:
    """(tier, s1, s2, s3, reward, n_requests): mean temperature, mean of temperature by size, response time, reward.

    The reward is the mean response time; its decay by place divides whole numbers, so that it is one throughout.
    """
    own = objects.groupBy("tier").agg(F.avg("hot").alias("s1"), F.avg(F.col("hot") * F.col("size")).alias("s2"))
    asked = requests.groupBy("tier").agg(F.sum("rt").alias("s3"), F.count("*").alias("n_requests"))
    rows = own.join(asked, "tier", "left").na.fill({"s3": 0, "n_requests": 0})
    return rows.withColumn("reward", F.coalesce(F.try_divide(F.col("s3").cast("double"), F.col("n_requests")), F.lit(0.0)))


def decayed_reward(requests: DataFrame, beta: float = learning.BETA) -> DataFrame:
    """(tier, reward) with the decay as meant: by place over number of requests, in order of seq."""
    n = F.broadcast(requests.groupBy("tier").agg(F.count("*").alias("n")))  # a row per tier
    rows = ranges.sum_ahead(requests.select("tier", "seq", "rt"), F.lit(1), [F.asc("seq")], "tier", name="i").join(n, "tier")
    return rows.groupBy("tier").agg((F.sum(F.col("rt") * F.exp(-beta * F.col("i") / F.col("n"))) / F.max("n")).alias("reward"))


def coldest(objects: DataFrame) -> DataFrame:
    """The object of least temperature of each tier, the smallest id of equal ones."""
    best = F.min(F.struct("hot", "object_id")).alias("best")
    return objects.groupBy("tier").agg(best).select("tier", F.col("best.object_id").alias("object_id"), F.col("best.hot").alias("hot"))


def leave_one_out(objects: DataFrame) -> DataFrame:
    """objects with the state of their tier without them: s1_not, s2_not."""
    sums = objects.groupBy("tier").agg(F.sum("hot").alias("_h"), F.sum(F.col("hot") * F.col("size")).alias("_hs"), F.count("*").alias("_n"))
    rows = objects.join(F.broadcast(sums), "tier")
    s1 = learning.without(F.col("_h"), F.col("_n"), F.col("hot"), learning.EMPTY[0])
    s2 = learning.without(F.col("_hs"), F.col("_n"), F.col("hot") * F.col("size"), learning.EMPTY[1])
    return rows.withColumns({"s1_not": s1, "s2_not": s2}).drop("_h", "_hs", "_n")


def td_learn(steps: DataFrame, a: list[float], b: list[float], p: list[float], lam: float = 0.8, beta: float = learning.BETA) -> DataFrame:
    """(tier, p): the cost weights after temporal-difference learning over steps (tier, step, s1, s2, s3, reward).

    A tier's steps are learned from one after another; there is one per epoch of the policy. What rules have weighed
    so far is carried as sums, so a step costs the same however many came before.
    """
    import numpy as np
    import pandas as pd

    def weights(state):
        large = [1 / (1 + x * np.exp(-y * s)) for x, y, s in zip(a, b, state, strict=True)]
        w = np.einsum("i,j,k->ijk", *[np.array([1 - v, v]) for v in large]).ravel()
        return w / w.sum()

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("step")
        own, z, seen, last = np.array(p, float), np.zeros(8), np.zeros(8), np.zeros(8)
        states = rows[["s1", "s2", "s3"]].to_numpy()
        for state, reward, after in zip(states, rows["reward"], states[1:], strict=False):
            phi, phi_next = weights(state), weights(after)
            decay = np.exp(-beta * state[2])
            z = lam * decay * z + phi
            own = own + 0.1 / (1 + 100 * seen) * (reward + decay * (own @ phi_next) - own @ phi) * z
            seen, last = seen + last, phi_next
        return pd.DataFrame({"tier": [int(rows["tier"].iloc[0])], "p": [own.tolist()]})

    return steps.groupBy("tier").applyInPandas(learn, "tier int, p array<double>")


def reuse_cache(trace: DataFrame, span: int) -> DataFrame:
    """(part, hits, misses, evictions) of a cache that keeps an entry for `span` steps of seq after its last use: trace is (part, seq, key).

    What a second-chance cache holds, told by how long ago each key was used last instead of by turning its hand: each
    access looks back to the one before it of its own key, so parts of any size spread over their keys.
    """
    w = Window.partitionBy("part", "key").orderBy("seq")
    rows = trace.select("part", "seq", F.lag("seq").over(w).alias("before"))
    hit = F.coalesce(F.col("seq") - F.col("before") <= span, F.lit(False))
    again = F.col("before").isNotNull() & ~hit
    return rows.groupBy("part").agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.count_if(again).alias("evictions"))

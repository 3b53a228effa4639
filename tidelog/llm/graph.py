"""Links between documents: connected components, and tests of all pairs of a group in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Rows of one key from which `components` joins it by broadcast: with E links at most 2 * E / HUB keys have them.
HUB = 100_000


def components(edges: DataFrame, ws: Workspace, hub: int = HUB) -> DataFrame:
    """(id, comp): for each id of edges (a, b) the least id that it is connected to, as a table of ws.

    Each round takes the least label of the neighbours, then the label of the label, and is written as a table;
    only whether a label changed reaches the driver. A node with many neighbours, or a label of many nodes, is one key of
    many rows: what belongs to it is broadcast, so that no task gets all rows of one.
    """
    both = ws.table(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = ws.table(both.groupBy(F.col("a").alias("id")).agg(F.least("a", F.min("b")).alias("comp")), "labels")
    large = labels.count() > hub  # else no key has so many rows
    while True:
        near = _join(both, labels.select(F.col("id").alias("b"), "comp"), "b", "inner", hub if large else None)
        near = near.groupBy("a").agg(F.min("comp").alias("near"))
        lower = labels.join(near, labels["id"] == near["a"]).select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        above = labels.filter("id <> comp").select(F.col("id").alias("comp"), F.col("comp").alias("top"))
        lower = _join(lower, above, "comp", "left", hub if large else None)
        after = ws.table(lower.select("id", "old", F.least("comp", "top").alias("comp")), "labels")
        ws.drop(labels)
        if after.filter("old <> comp").isEmpty():
            ws.drop(both)
            return after
        labels = after


def _join(left: DataFrame, right: DataFrame, key: str, how: str, hub: int | None) -> DataFrame:
    """left joined to right, which has a row per key: for keys with over `hub` rows of left, at most left/hub, by broadcast."""
    if hub is None:
        return left.join(right, key, how)
    hubs = F.broadcast(left.groupBy(key).count().filter(F.col("count") > hub).select(key))
    of_hubs = F.broadcast(right.join(hubs, key, "left_semi"))
    return left.join(hubs, key, "left_semi").join(of_hubs, key, how).unionByName(left.join(hubs, key, "left_anti").join(right, key, how))


#: `test` of a block gets its rows as a dict of columns and answers for a row x which rows of `others` it is linked to.
Test = Callable[[dict], Callable[[int, np.ndarray], np.ndarray]]


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The slices of sorted batches that have equal keys, each with its keys; a group may come in many slices."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield tuple(c[lo] for c in columns), batch.slice(lo, hi - lo)


def _columns(held: list[pa.RecordBatch]) -> dict:
    table = pa.Table.from_batches(held)
    return {c: table.column(c) for c in table.column_names}


def _pairs(found: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[int, int]] = []
    for pair in found:
        out.append(pair)
        if len(out) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])


def _inside(held: list[pa.RecordBatch], test: Test) -> Iterator[tuple[int, int]]:
    """What tests connect within a block, as pairs with the least id of each part. What is connected needs no test."""
    if sum(b.num_rows for b in held) < 2:
        return
    columns = _columns(held)
    ids = columns["id"].to_numpy()
    near = test(columns)
    label = np.arange(len(ids))
    for x in range(len(ids) - 1):
        others = np.arange(x + 1, len(ids))
        others = others[label[others] != label[x]]
        if len(others) and len(linked := near(x, others)):
            label[np.isin(label, label[linked])] = label[x]
    least: dict[int, int] = {}
    for i, k in zip(ids.tolist(), label.tolist(), strict=True):
        least[k] = min(i, least.get(k, i))
    for i, k in zip(ids.tolist(), label.tolist(), strict=True):
        if i != least[k]:
            yield least[k], i


def meet(rows: DataFrame, group: str, test: Test, ws: Workspace, most_rows: int, most_bytes: int = 1 << 23) -> DataFrame:
    """(a, b): pairs of ids with the same connected parts as all pairs of rows of one group that `test` links.

    rows: group, id, bytes and what test reads. A group is dealt to blocks of bounded size. First each block is tested
    within itself, its group's least row among it: where all are much alike this connects the whole group, with work
    in proportion to its rows. Only in groups that are still in parts do rows meet other blocks: those outside the largest part
    go to each block and meet what they are not connected to. No link is left out and no pairs are listed.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col("bytes").cast("long")).alias("all_bytes"), F.min("id").alias("lead"))
    blocks = F.ceil(F.greatest(F.col("n") / most_rows, F.col("all_bytes") / most_bytes)).cast("int")
    sizes = ws.table(sizes.filter("n > 1").select(group, F.greatest(blocks, F.lit(1)).alias("blocks"), "lead"), "sizes")
    dealt = rows.join(sizes, group).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = ws.table(dealt, "dealt")
    ws.drop(sizes)
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    with_lead = dealt.withColumn("to", F.explode(F.when(F.col("id") == F.col("lead"), every).otherwise(F.array("own"))))

    def inside(batches):
        def found():
            held, last = [], None
            for key, part in _runs(batches, group, "to"):
                if key != last:
                    yield from _inside(held, test)
                    held, last = [], key
                held.append(part)
            yield from _inside(held, test)

        return _pairs(found())

    sort = lambda r, *by: r.repartition(group, "to").sortWithinPartitions(group, "to", *by)
    edges = ws.table(sort(with_lead).mapInArrow(inside, "a long, b long").distinct(), "links")
    wide = dealt.filter("blocks > 1")
    if wide.isEmpty():
        ws.drop(dealt)
        return edges

    labels = components(edges, ws)
    known = wide.join(labels.select("id", F.col("comp").alias("part")), "id", "left").withColumn("part", F.coalesce("part", "id"))
    parts = known.groupBy(group, "part").agg(F.count("*").alias("rows"))
    parts = parts.groupBy(group).agg(F.max_by("part", F.struct("rows", "part")).alias("largest"), F.count("*").alias("parts")).filter("parts > 1")
    parts = ws.table(parts.select(group, "largest"), "parts")
    known = known.join(parts, group)
    to = F.explode(F.when(F.col("part") == F.col("largest"), F.array("own")).otherwise(every))
    visits = known.withColumn("to", to).withColumn("visits", F.col("own") != F.col("to"))

    def across(batches):
        def found():
            home, at = [], None
            for (*key, visiting), part in _runs(batches, group, "to", "visits"):
                if key != at:
                    home, at = [], key
                if not visiting:
                    home.append(part)
                elif home:
                    yield from _between(home, part, test)

        return _pairs(found())

    more = ws.table(sort(visits, "visits").mapInArrow(across, "a long, b long").distinct(), "links")
    both = ws.table(edges.unionByName(more), "links")
    ws.drop(dealt, labels, parts, edges, more)
    return both


def _between(home: list[pa.RecordBatch], visitors: pa.RecordBatch, test: Test) -> Iterator[tuple[int, int]]:
    """Pairs that tests link between the rows of a block and visitors that are not connected to them."""
    n = sum(b.num_rows for b in home)
    columns = _columns([*home, visitors])
    ids, label, own = (columns[c].to_numpy() for c in ("id", "part", "own"))
    largest = columns["largest"][0].as_py()
    near = test(columns)
    for x in range(n, len(ids)):
        others = np.flatnonzero(label[:n] != label[x])
        # two rows outside the largest part would meet in both of their blocks
        others = others[(label[others] == largest) | (own[others] > own[x])]
        if len(others):
            for y in near(x, others):
                yield min(int(ids[x]), int(ids[y])), max(int(ids[x]), int(ids[y]))

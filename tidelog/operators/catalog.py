"""Datasets, object stores, snapshots and what they keep alive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranges

#: The default object store has no name of its own and is not listed by name.
DEFAULT_STORE = ""


def by_name(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """Catalog rows of asked names with a status: found, or does not exist."""
    rows = names.join(catalog, "name", "left")
    return rows.withColumn("status", F.when(F.col("id").isNull(), "does not exist").otherwise("found"))


def create_dataset(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """(name, id, status) for each asked name: created with the next id, or already exists."""
    top = catalog.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top"))
    asked = names.distinct().join(catalog.select("name", "id"), "name", "left")
    # a request names few datasets: one partition numbers them
    fresh = asked.filter("id IS NULL").crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + F.row_number().over(Window.orderBy("name")))
    return fresh.select("name", F.col("id").cast("long").alias("id"), F.lit("created").alias("status")).unionByName(asked.filter("id IS NOT NULL").select("name", "id", F.lit("already exists").alias("status")))


def snapshots_with_neighbours(snapshots: DataFrame) -> DataFrame:
    """snapshots (ds_id, name, gen) with the generations before and after each in its dataset."""
    order = Window.partitionBy("ds_id").orderBy("gen")
    return snapshots.withColumns({"prev_gen": F.lag("gen").over(order), "next_gen": F.lead("gen").over(order)})


def freed_by_delete(snapshots: DataFrame, deadlist: DataFrame) -> DataFrame:
    """(ds_id, gen, blocks): dead blocks that go when a snapshot is deleted.

    They died after the snapshot and not after the next one, and were born after the one before it (any, if it is the first).
    """
    near = snapshots_with_neighbours(snapshots).select("ds_id", "gen", "prev_gen")
    mark = F.struct("gen", "prev_gen").alias("mark")
    marks = near.select("ds_id", F.col("gen").alias("at"), F.lit(True).alias("is_mark"), mark)
    dead = deadlist.select("ds_id", F.col("died_gen").alias("at"), F.lit(False).alias("is_mark"), "birth", "size")
    # lined up by generation, a block after the last snapshot before its death: no block meets more than that one
    line = marks.unionByName(dead, allowMissingColumns=True)
    rows = ranges.last_known(line, F.col("mark"), [F.asc("at"), F.asc("is_mark")], "ds_id", name="mark")
    found = rows.filter(~F.col("is_mark") & F.col("mark").isNotNull() & (F.col("birth") > F.coalesce("mark.prev_gen", F.lit(-1))))
    return found.groupBy("ds_id", F.col("mark.gen").alias("gen")).agg(F.sum("size").alias("blocks"))


def copy_on_write(dead: DataFrame, snapshots: DataFrame) -> DataFrame:
    """dead (ds_id, birth, size) with its fate: preserved if the last snapshot saw its birth, else removed."""
    last = snapshots.groupBy("ds_id").agg(F.max("gen").alias("last"))
    rows = dead.join(last, "ds_id", "left")
    return rows.withColumn("fate", F.when(F.coalesce("last", F.lit(-1)) < F.col("birth"), "removed").otherwise("preserved")).drop("last")


def newest_superblock(slots: DataFrame) -> DataFrame:
    """The newest valid superblock of each device: slots are (device, slot, generation, valid, payload)."""
    return slots.filter("valid").groupBy("device").agg(F.max("generation").alias("generation"), F.max_by("payload", "generation").alias("payload"))

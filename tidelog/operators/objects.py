"""Objects: sparse byte arrays in chunks, with a metadata table and custom metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import chunks as C
from . import log as L
from . import ranges


def fold_info(messages: DataFrame) -> DataFrame:
    """One row per present object_key: object_id, size, mtime, pref, access_pattern of its metadata messages.

    messages: object_key, seq, op and the fields. R replaces all fields, D deletes, P patches: of patches since the
    last R the newest non-null object_id, pref and access_pattern win, and size and mtime are the largest. Patches after
    a D find no object and do nothing; without any R or D the patches stand for themselves.
    """
    whole = F.when(F.col("op").isin("R", "D"), F.col("seq"))
    s0 = messages.groupBy(F.col("object_key").alias("_key")).agg(F.max(whole).alias("s0"), F.max_by("op", whole).alias("last"))
    s0 = s0.filter(F.coalesce("last", F.lit("R")) != "D").drop("last")
    same = messages["object_key"].eqNullSafe(s0["_key"])
    rows = messages.join(s0, same).filter((F.col("op") != "D") & (F.col("seq") >= F.coalesce("s0", F.lit(-(2**63)))))
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return rows.groupBy("object_key").agg(newest("object_id"), F.max("size").alias("size"), F.max("mtime").alias("mtime"), newest("pref"), newest("access_pattern"))


def write_chunks(writes: DataFrame, size: int = C.CHUNK) -> DataFrame:
    """writes (object_id, seq, offset, data) cut at chunk bounds: object_id, chunk_id, seq, begin, data.

    Data is cut before its pieces become rows, so that no row carries more than its own piece.
    """

    def piece(c: Column) -> Column:
        start = c["chunk_id"] * size + c["begin"] - F.col("offset")
        return F.struct(c["chunk_id"].alias("chunk_id"), c["begin"].alias("begin"), F.substring(F.col("data"), (start + 1).cast("int"), (c["end"] - c["begin"]).cast("int")).alias("data"))

    parts = F.transform(C.chunk_split(F.col("offset"), F.length("data").cast("long"), size), piece)
    return writes.select("object_id", "seq", F.explode(parts).alias("c")).select("object_id", "c.chunk_id", "seq", "c.begin", "c.data")


def apply_writes(writes: DataFrame, size: int = C.CHUNK, start: int | None = None, stop: int | None = None) -> DataFrame:
    """(object_id, chunk_id, data): what chunks hold after writes (object_id, seq, offset, data as bytes), newer ones over older.

    A chunk is a block of the message log, and a write an upsert. With start and stop only the bytes at [start, stop) are
    laid, all that a read of that range needs; what chunks hold outside it is then left out.
    """
    end = (F.col("offset") + F.length("data")).alias("end")
    cut = L.runs(F.col("offset").cast("long"), F.col("data"), size, start, stop)
    rows = writes.select("object_id", "seq", end, F.explode(cut).alias("c")).select("object_id", "seq", "end", "c.*")
    return L.lay_over(rows, "object_id").select("object_id", F.col("block").alias("chunk_id"), F.col("bytes").alias("data"))


def grown_sizes(writes: DataFrame) -> DataFrame:
    """(object_id, size): how far the writes of each object reach."""
    return writes.groupBy("object_id").agg(F.max(F.col("offset") + F.length("data")).alias("size"))


def read_at(objects: DataFrame, chunks: DataFrame, offset: int | Column, length: int | Column, size: int = C.CHUNK, zero: str = "0") -> DataFrame:
    """(object_id, n, data): `length` bytes of each object from `offset`, zero bytes where no chunk is, up to its size.

    objects: object_id, size. chunks: object_id, chunk_id, data. Only the chunks that the range touches are read. Chunks of
    text are read by characters, with the character `zero` in place of zero bytes.
    """
    is_bytes = chunks.schema["data"].dataType == T.BinaryType()
    if isinstance(offset, int) and isinstance(length, int):  # chunks outside the range need not be read at all
        chunks = chunks.filter(F.col("chunk_id").between(offset // size, (offset + length) // size))
    offset, length = (F.lit(x) if isinstance(x, int) else x for x in (offset, length))
    n = F.greatest(F.least(length, F.col("size") - offset), F.lit(0)).cast("long")
    asked = objects.select("object_id", offset.cast("long").alias("at"), n.alias("n"))
    parts = asked.select("object_id", "n", F.explode_outer(C.chunk_split(F.col("at"), F.col("n"), size)).alias("c"))
    parts = parts.select("object_id", "n", "c.chunk_id", "c.begin", "c.end")
    long = (F.col("end") - F.col("begin")).cast("int")
    empty = F.unhex(F.lit("")) if is_bytes else F.lit("")
    piece = F.substring(F.coalesce("data", empty), (F.col("begin") + 1).cast("int"), long)
    piece = F.rpad(F.hex(piece), 2 * long, "0") if is_bytes else F.rpad(piece, long, zero)
    found = parts.join(chunks, ["object_id", "chunk_id"], "left")
    read = found.groupBy("object_id", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", piece.alias("piece")))), lambda x: x["piece"]), "").alias("data"))
    whole = F.coalesce("data", F.lit(""))
    return read.select("object_id", "n", (F.unhex(whole) if is_bytes else whole).alias("data"))


def read_written(writes: DataFrame, offset: int, length: int, size: int = C.CHUNK) -> DataFrame:
    """read_at of what writes (object_id, seq, offset, data as bytes) leave; of each write only what the range covers is laid."""
    return read_at(grown_sizes(writes), apply_writes(writes, size, offset, offset + length), offset, length, size)


def chunk_ranges(chunks: DataFrame, first: int | None = None, last: int | None = None, size: int = C.CHUNK) -> DataFrame:
    """(object_id, chunk_id, start, end) of allocated chunks with ids in [first, last)."""
    rows = chunks
    if first is not None:
        rows = rows.filter(F.col("chunk_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("chunk_id") < last)
    return rows.select("object_id", "chunk_id", (F.col("chunk_id") * size).alias("start"), (F.col("chunk_id") * size + F.length("data")).alias("end"))


def holes(chunks: DataFrame, size: int = C.CHUNK) -> DataFrame:
    """(object_id, start, end): the gaps before each allocated chunk."""
    order = Window.partitionBy("object_id").orderBy("chunk_id")
    rows = chunk_ranges(chunks, size=size).withColumn("before", F.coalesce(F.lag("end").over(order), F.lit(0)))
    return rows.filter("start > before").select("object_id", F.col("before").alias("start"), F.col("start").alias("end"))


def allocated(objects: DataFrame, chunks: DataFrame) -> DataFrame:
    """(object_id, size, stored): logical size and the characters that chunks hold."""
    own = chunks.groupBy("object_id").agg(F.sum(F.length("data")).alias("stored"))
    return objects.join(own, "object_id", "left").select("object_id", "size", F.coalesce("stored", F.lit(0)).cast("long").alias("stored"))


def create(objects: DataFrame, names: DataFrame) -> DataFrame:
    """(object_key, object_id) of names that are not there yet, with the next ids in order of their names.

    Ids are dealt by ranges of names.
    """
    new = names.join(objects, "object_key", "left_anti").distinct()
    top = objects.agg(F.coalesce(F.max("object_id"), F.lit(-1)).alias("top"))
    numbered = ranges.sum_ahead(new.select("object_key"), F.lit(1), [F.asc("object_key")])
    return numbered.crossJoin(F.broadcast(top)).select("object_key", (F.col("top") + F.col("before") + 1).alias("object_id"))


def rename(objects: DataFrame, old: Column, new: Column) -> DataFrame:
    """objects with one key renamed; an object that had the new key is gone."""
    return objects.filter(F.col("object_key") != new).withColumn("object_key", F.when(F.col("object_key") == old, new).otherwise(F.col("object_key")))


def delete(objects: DataFrame, chunks: DataFrame, meta: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Objects, chunks and metadata without the objects whose object_id is in gone."""
    return tuple(t.join(gone, "object_id", "left_anti") for t in (objects, chunks, meta))


def seek(position: Column, size: Column, whence: str, by: Column) -> Column:
    """The cursor's new place from "start", "end" or "current"; null if that lies before the object."""
    base = {"start": F.lit(0), "end": size, "current": position}[whence]
    return F.when(base + by >= 0, base + by)


def migrate(objects: DataFrame, tiers: DataFrame, target: Column) -> DataFrame:
    """objects (object_id, tier, size) with the tier they are to move to and a status.

    Statuses: no such tier, too large (for the target's free space), same tier, moved.
    """
    rows = objects.withColumn("target", target.cast("int"))
    space = F.broadcast(tiers.filter(F.col("tier").between(0, 3)).select(F.col("tier").alias("target"), "free"))  # four tiers at most
    status = F.when(F.col("free").isNull(), "no such tier").when(F.col("target") == F.col("tier"), "same tier").when(F.col("size") > F.col("free"), "too large").otherwise("moved")
    return rows.join(space, "target", "left").select("object_id", "tier", "target", "size", status.alias("status"))

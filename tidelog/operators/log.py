"""The ordered message log and its resolution to current values.

A log row is (key BINARY, seq BIGINT, gen BIGINT, op, offset INT, data BINARY, nbits INT, bit BOOLEAN): I inserts, D
deletes, U writes data over the value at a byte offset, B sets nbits bits from a bit offset. seq is unique for a key.

The value of a key follows from its last insert or delete and what came later: each byte is that of the newest message
that covers it. Messages are cut at the bounds of blocks of bytes, and what covers a block in part into a few runs as long as
powers of two. Of runs of the same place the newest counts, an aggregate with a partial form; the runs that are left of a
block, fewer than two for each byte, are laid over each other. So no key's messages are gathered in a list, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bytes as by
from ..functions import chunks as C

#: Largest value of one message.
MOST_BYTES = 524_288
#: Bytes of a block in which messages are laid over each other.
BLOCK = 4096

LOG_SCHEMA = "key binary, seq bigint, gen bigint, op string, offset int, data binary, nbits int, bit boolean"


def checked(log: DataFrame) -> DataFrame:
    """log, failing on rows that no log may hold: empty keys, values over the limit, unknown operations."""
    bad = (
        F.when(F.coalesce(F.length("key"), F.lit(0)) == 0, "empty key")
        .when(F.coalesce(F.col("offset"), F.lit(0)) + F.coalesce(F.length("data"), F.lit(0)) > MOST_BYTES, "value too large")
        .when(~F.col("op").isin("I", "D", "U", "B"), "unknown operation")
    )
    return log.filter(F.when(bad.isNotNull(), F.raise_error(bad)).otherwise(F.lit(True)))


def overwrites(log: DataFrame) -> DataFrame:
    """(key, s0, plain): the seq of each key's last insert or delete, null if it has none, and whether an insert is its newest message."""
    whole = F.when(F.col("op").isin("I", "D"), F.col("seq"))
    inserted = F.max(F.when(F.col("op") == "I", F.col("seq")))
    return log.groupBy("key").agg(F.max(whole).alias("s0"), (F.coalesce(inserted, F.lit(-(2**63))) == F.max("seq")).alias("plain"))


def _live(log: DataFrame) -> DataFrame:
    s0 = overwrites(log).withColumnRenamed("key", "_key")
    return log.join(s0, log["key"] == s0["_key"]).filter((F.col("op") != "D") & (F.col("seq") >= F.coalesce("s0", F.lit(-(2**63)))))


def live_messages(log: DataFrame) -> DataFrame:
    """The messages that still count: each key's last insert and the upserts after its last insert or delete."""
    return _live(log).drop("_key", "s0", "plain")


def runs(offset: Column, data: Column, block: int, start: int | None = None, stop: int | None = None) -> Column:
    """array<struct<block, begin, n, mask, bytes>>: data at an offset, cut at the bounds of blocks of so many bytes.

    With start and stop only the bytes at [start, stop) are cut out.

    What covers a block in part is cut on: its runs are as long as powers of two and begin at multiples of their lengths in the block.
    So a message has few runs, and a block has fewer than two different ones for each of its bytes, however many messages there are.
    """

    def cut(data: Column) -> Column:
        begin = offset if start is None else F.greatest(offset, F.lit(start))
        end = offset + F.length(data)
        end = end if stop is None else F.least(end, F.lit(stop))

        def run(b: Column, begin: Column, n: Column) -> Column:
            own = F.substring(data, (b * block + begin - offset + 1).cast("int"), n.cast("int"))
            return F.struct(b.alias("block"), begin.cast("int").alias("begin"), n.cast("int").alias("n"), F.lit(255).alias("mask"), own.alias("bytes"))

        def of_block(b: Column) -> Column:
            low, high = F.greatest(begin - b * block, F.lit(0)).cast("int"), F.least(end - b * block, F.lit(block)).cast("int")

            def of_length(k: Column) -> Column:
                n = F.call_function("shiftleft", F.lit(1), k)
                first, last = F.call_function("shiftright", low + n - 1, k), F.call_function("shiftright", high, k)
                odd = lambda c: (first < last) & (c % 2 == 1)
                return F.array(F.when(odd(first), run(b, first * n, n)), F.when(odd(last), run(b, (last - 1) * n, n)))

            lengths = F.sequence(F.lit(0), F.length(F.bin(high - low)) - 1)
            parts = F.filter(F.flatten(F.transform(lengths, of_length)), lambda x: x.isNotNull())
            return F.when(high - low == block, F.array(run(b, F.lit(0), F.lit(block)))).otherwise(parts)

        blocks = F.sequence(C.div(begin, block), C.div(end - 1, block))
        # greatest and least pass over nulls: a write without bytes or place has no runs
        return F.when((offset + F.length(data) > offset) & (begin < end), F.flatten(F.transform(blocks, of_block))).otherwise(F.array().cast(_RUNS))

    # each look at a column of bytes copies all of them: taken up once, as a variable, a write costs its length, not that times its blocks
    return F.flatten(F.transform(F.array(data), cut))


_RUNS = "array<struct<block:bigint,begin:int,n:int,mask:int,bytes:binary>>"


def _bit_runs(offset: Column, nbits: Column, bit: Column, block: int) -> Column:
    """Runs of one byte whose mask says which of its bits are set or cleared."""
    ones = lambda n: F.call_function("shiftleft", F.lit(1), n) - 1
    mask = lambda p: ones(F.least(offset + nbits - 8 * p, F.lit(8)).cast("int")) - ones(F.greatest(offset - 8 * p, F.lit(0)).cast("int"))
    byte = lambda p: F.unhex(F.lpad(F.hex(F.when(bit, mask(p)).otherwise(0).cast("long")), 2, "0"))
    run = lambda p: F.struct(C.div(p, block).alias("block"), (p % block).cast("int").alias("begin"), F.lit(1).alias("n"), mask(p).alias("mask"), byte(p).alias("bytes"))
    return F.when(nbits > 0, F.transform(F.sequence(C.div(offset, 8), C.div(offset + nbits - 1, 8)), run)).otherwise(F.array().cast(_RUNS))


def lay_over(rows: DataFrame, *key: str) -> DataFrame:
    """(key, block, bytes, end) of runs (key, seq, end, block, begin, n, mask, bytes): each byte and bit of a block is that of its newest run.

    Of equal places the newest run counts, an aggregate with a partial form; what is left of a block is laid over in order.
    """
    newest = rows.groupBy(*key, "block", "begin", "n", "mask").agg(F.max_by("bytes", "seq").alias("bytes"), F.max("seq").alias("seq"), F.max("end").alias("end"))
    order = newest.groupBy(*key, "block").agg(F.array_sort(F.collect_list(F.struct("seq", "begin", "mask", "bytes"))).alias("runs"), F.max("end").alias("end"))
    number = lambda c: F.coalesce(F.conv(F.hex(c), 16, 10).cast("int"), F.lit(0))

    def put(under: Column, x: Column) -> Column:
        old = number(F.substring(under, x["begin"] + 1, F.lit(1)))
        bits = old.bitwiseAND(F.lit(255) - x["mask"]).bitwiseOR(number(x["bytes"]))
        byte = F.unhex(F.lpad(F.hex(bits.cast("long")), 2, "0"))
        return F.when(x["mask"] == 255, by.overlay_at(under, x["begin"], x["bytes"])).otherwise(by.overlay_at(under, x["begin"], byte))

    return order.select(*key, "block", F.aggregate("runs", F.unhex(F.lit("")), put).alias("bytes"), "end")


def resolve(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, value): the current value of each key that has one, put together from blocks of so many bytes."""
    offset, size, nbits = F.col("offset"), F.length("data"), F.coalesce("nbits", F.lit(0))
    run = lambda b, data: F.struct(b.cast("long").alias("block"), F.lit(0).alias("begin"), F.length(data).alias("n"), F.lit(255).alias("mask"), data.alias("bytes"))
    end = F.when(F.col("plain"), size).when(F.col("op") == "B", F.ceil((offset + nbits) / 8)).otherwise(offset + size).cast("int")
    found = F.when(F.col("op") == "B", _bit_runs(offset, nbits, F.col("bit"), block)).otherwise(runs(offset, F.col("data"), block))
    # a key that is one insert is not cut; a message that writes nothing still says how far it reaches
    nothing = F.array(run(C.div(F.greatest(F.col("end") - 1, F.lit(0)), block), F.unhex(F.lit(""))))
    cut = F.when(F.col("plain"), F.array(run(F.lit(-1), F.col("data")))).otherwise(found)
    live = _live(log).select("key", "seq", end.alias("end"), cut.alias("runs"))
    rows = live.select("key", "seq", "end", F.explode(F.when(F.size("runs") == 0, nothing).otherwise(F.col("runs"))).alias("c")).select("key", "seq", "end", "c.*")
    part = F.struct("block", F.hex("bytes").alias("digits"))
    order = lay_over(rows, "key").groupBy("key").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max("end").alias("size"))
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.try_element_at("parts", F.greatest(i, F.lit(1)))["block"])

    def placed(x: Column, i: Column) -> Column:
        gap = F.repeat(F.lit("00"), (F.greatest(x["block"] - before(i) - 1, F.lit(0)) * block).cast("int"))
        return F.concat(gap, F.when(i + 1 == F.size("parts"), x["digits"]).otherwise(F.rpad(x["digits"], 2 * block, "0")))

    text = F.array_join(F.transform("parts", placed), "")
    return order.select("key", F.unhex(F.rpad(text, (2 * F.col("size")).cast("int"), "0")).alias("value"))


def resolve_by_fold(log: DataFrame) -> DataFrame:
    """resolve for logs without bit upserts, by an ordered fold: for keys with few messages of large values."""
    live = live_messages(log)
    ordered = F.array_sort(F.collect_list(F.struct("seq", "offset", "data")))
    start = F.unhex(F.lit(""))
    value = F.aggregate("messages", start, lambda acc, m: by.overlay_at(acc, m["offset"], m["data"]))
    return live.groupBy("key").agg(ordered.alias("messages")).select("key", value.alias("value"))


def compact(log: DataFrame) -> DataFrame:
    """A log of one insert for each present key that resolves to the same values."""
    last = log.groupBy(F.col("key").alias("_key")).agg(F.max("seq").alias("seq"), F.max("gen").alias("gen"))
    values = resolve(log)
    joined = values.join(last, values["key"] == last["_key"])
    return joined.select("key", "seq", "gen", F.lit("I").alias("op"), F.lit(0).alias("offset"), F.col("value").alias("data"), F.lit(None).cast("int").alias("nbits"), F.lit(None).cast("boolean").alias("bit"))


def as_of(log: DataFrame, gen: int) -> DataFrame:
    """The log as a snapshot of that generation sees it."""
    return log.filter(F.col("gen") <= gen)


def key_range(rows: DataFrame, low: bytes | Column | None = None, high: bytes | Column | None = None, low_open: bool = False, high_open: bool = True) -> DataFrame:
    """Rows whose key lies in a range; half-open unless said otherwise. Given bytes that can hold no key are an error."""
    if isinstance(low, bytes) and isinstance(high, bytes) and (low > high or low == high and (low_open or high_open)):
        raise ValueError("invalid range")
    low, high = (F.lit(bytearray(b)) if isinstance(b, bytes) else b for b in (low, high))
    if low is not None:
        rows = rows.filter(F.col("key") > low if low_open else F.col("key") >= low)
    if high is not None:
        rows = rows.filter(F.col("key") < high if high_open else F.col("key") <= high)
    return rows


def range_delete(log: DataFrame, low: bytes | Column, high: bytes | Column, seq: int, gen: int) -> DataFrame:
    """log with a delete for each key in [low, high)."""
    gone = key_range(log.select("key"), low, high).distinct()
    null = lambda t: F.lit(None).cast(t)
    rows = gone.select("key", F.lit(seq).cast("long").alias("seq"), F.lit(gen).cast("long").alias("gen"), F.lit("D").alias("op"), F.lit(0).alias("offset"), F.unhex(F.lit("")).alias("data"), null("int").alias("nbits"), null("boolean").alias("bit"))
    return log.unionByName(rows)


def merge_scan(base: DataFrame, log: DataFrame) -> DataFrame:
    """(key, value) of a resolved base with later messages over it: keys without messages are not touched."""
    # a base value is its key's oldest insert: a key without messages has only that, and resolves to it as it is
    null = lambda t: F.lit(None).cast(t)
    under = base.select("key", F.lit(-1).cast("long").alias("seq"), F.lit(0).cast("long").alias("gen"), F.lit("I").alias("op"), F.lit(0).alias("offset"), F.col("value").alias("data"), null("int").alias("nbits"), null("boolean").alias("bit"))
    return resolve(under.unionByName(log))


def multi_get(values: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value) for every asked key; value is null where there is none."""
    return keys.join(values, "key", "left")


def latest(rows: DataFrame, key: str, seq: str, *columns: str) -> DataFrame:
    """The columns of each key's newest row."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), seq).alias("_r")).select(key, *[f"_r.{c}" for c in columns])


def ranked(rows: DataFrame, seq: str, *by_columns: str) -> DataFrame:
    """rows with `rank`, 1 for the newest of each group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by_columns).orderBy(F.desc(seq))))

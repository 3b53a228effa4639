"""The test tables read as the engine's own: a message log, objects and chunks, an access log, allocations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytes as by

#: Characters of a chunk of the test objects.
CHUNK = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def k_of(props: str = "props") -> Column:
    return F.get_json_object(props, "$.k").cast("int")


def message_log(spark: SparkSession, sf_dir: str, bits: bool = False) -> DataFrame:
    """events as a log: key user_id, seq event_id; signup inserts, error deletes, the others write four bytes at k % 16.

    With bits, click events set or clear seven bits from bit k instead.
    """
    kind = F.col("event_type")
    op = F.when(kind == "signup", "I").when(kind == "error", "D").when((kind == "click") & F.lit(bits), "B").otherwise("U")
    rows = table(spark, sf_dir, "events").select(
        by.be_encode(F.col("user_id")).alias("key"), F.col("event_id").cast("long").alias("seq"), F.expr("event_id div 1000").alias("gen"), op.alias("op"), k_of().alias("k"), (F.col("value") > 50).alias("bit"), by.be_encode(F.col("event_id"), 4).alias("bytes")
    )
    return rows.select(
        "key",
        "seq",
        "gen",
        "op",
        F.when(F.col("op") == "U", F.col("k") % 16).when(F.col("op") == "B", F.col("k")).otherwise(0).alias("offset"),
        F.when(F.col("op").isin("I", "U"), F.col("bytes")).otherwise(F.unhex(F.lit(""))).alias("data"),
        F.when(F.col("op") == "B", 7).alias("nbits"),
        F.when(F.col("op") == "B", F.col("bit")).alias("bit"),
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as objects: object_id, object_key, size (code points)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("object_id"), F.format_string("doc-%08d", "doc_id").alias("object_key"), F.length("text").cast("long").alias("size"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of documents in chunks of CHUNK characters; every third chunk is left out, as in a sparse object."""
    numbers = F.filter(F.sequence(F.lit(0), F.expr(f"(greatest(length(text), 1) - 1) div {CHUNK}").cast("int")), lambda c: c % 3 != 2)
    cut = F.transform(numbers, lambda c: F.struct(c.cast("long").alias("chunk_id"), F.substring(F.col("text"), c * CHUNK + 1, F.lit(CHUNK)).alias("data")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("object_id"), F.explode(cut).alias("c")).select("object_id", "c.*")


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as accesses: object_id, tier (object_id % 3), seq, response time in ms, size in bytes."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("object_id"), (F.col("user_id") % 3).cast("int").alias("tier"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("kind"), F.floor(F.col("value") * 100).cast("long").alias("rt"), (F.col("user_id") * 37 % 100 + 1).cast("long").alias("size")
    )


def allocation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as allocations: time, op (1 takes, 0 frees), tier, disk, segment, begin and n blocks in segments of 256."""
    k = k_of()
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("time"), F.when(F.col("event_type").isin("error", "view"), 0).otherwise(1).alias("op"), (F.col("user_id") % 3).cast("int").alias("tier"), (F.col("user_id") % 2).cast("int").alias("disk"), (F.col("user_id") % 5).cast("int").alias("segment"), (F.col("event_id") * 7919 % 248).cast("int").alias("begin"), (k % 8 + 1).cast("int").alias("n")
    )


# The same in DuckDB, as common table expressions.
LOG_SQL = """
    log AS (
        SELECT printf('%016X', user_id) AS key, event_id AS seq, event_id // 1000 AS gen,
               CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op,
               CASE WHEN event_type IN ('signup', 'error') THEN 0
                    ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) % 16 END AS off,
               printf('%08X', event_id) AS data
        FROM events
    )"""


def value_sql(log: str = "log", out: str = "val") -> str:
    """CTEs that resolve a log: (key, value) with the value as hex."""
    return f"""
    {out}_live AS (
        SELECT l.* FROM {log} AS l
        JOIN (SELECT key, max(seq) FILTER (op IN ('I', 'D')) AS s0 FROM {log} GROUP BY key) AS s ON l.key = s.key
        WHERE op <> 'D' AND seq >= coalesce(s0, -1)
    ), {out}_size AS (
        SELECT key, max(off + length(data) // 2) AS size FROM {out}_live GROUP BY key
    ), {out}_byte AS (
        SELECT key, off + p AS pos, arg_max(substr(data, CAST(2 * p + 1 AS BIGINT), 2), seq) AS b
        FROM {out}_live, (SELECT unnest(range(64)) AS p) AS r WHERE p < length(data) // 2 GROUP BY key, off + p
    ), {out} AS (
        SELECT s.key, string_agg(coalesce(b, '00'), '' ORDER BY g.pos) AS value
        FROM {out}_size AS s
        JOIN (SELECT unnest(range(128)) AS pos) AS g ON g.pos < s.size
        LEFT JOIN {out}_byte AS y ON y.key = s.key AND y.pos = g.pos
        GROUP BY s.key
    )"""


OBJECTS_SQL = """
    objects AS (
        SELECT doc_id AS object_id, printf('doc-%08d', doc_id) AS object_key, CAST(length(text) AS BIGINT) AS size FROM documents
    )"""
CHUNKS_SQL = """
    chunks AS (
        SELECT doc_id AS object_id, CAST(c AS BIGINT) AS chunk_id, substr(text, CAST(c * 128 + 1 AS BIGINT), 128) AS data
        FROM (SELECT doc_id, text, unnest(range((greatest(length(text), 1) - 1) // 128 + 1)) AS c FROM documents)
        WHERE c % 3 <> 2
    )"""
ACCESS_SQL = """
    access AS (
        SELECT user_id AS object_id, CAST(user_id % 3 AS INTEGER) AS tier, event_id AS seq, ts, event_type AS kind,
               CAST(floor(value * 100) AS BIGINT) AS rt, CAST(user_id * 37 % 100 + 1 AS BIGINT) AS size
        FROM events
    )"""
ALLOC_SQL = """
    alloc AS (
        SELECT event_id AS time, CASE WHEN event_type IN ('error', 'view') THEN 0 ELSE 1 END AS op,
               CAST(user_id % 3 AS INTEGER) AS tier, CAST(user_id % 2 AS INTEGER) AS disk, CAST(user_id % 5 AS INTEGER) AS segment,
               CAST(event_id * 7919 % 248 AS INTEGER) AS begin_,
               CAST(json_extract_string(props, '$.k') AS INTEGER) % 8 + 1 AS n
        FROM events
    )"""

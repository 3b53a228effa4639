"""Queries of the key-value layer: scans, resolution, merges, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytes as by
from ..operators import log as L
from .tables import LOG_SQL, message_log, table, value_sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}
LOW, HIGH = 40, 90


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def shown(values: DataFrame) -> DataFrame:
    return values.select(F.hex("key").alias("key"), F.hex("value").alias("value"))


def values(spark: SparkSession, d: str) -> DataFrame:
    return L.resolve(message_log(spark, d))


def middle(log: DataFrame) -> int:
    """The last generation of the older half of a log."""
    return (log.agg(F.max("gen")).first()[0] or 0) // 2


def key(n: int):
    return by.be_encode(F.lit(n))


K = f"WITH {LOG_SQL}, {value_sql()}"
low, high = f"printf('%016X', {LOW})", f"printf('%016X', {HIGH})"


@query(f"{K} SELECT key, value FROM val")
def kv_resolve(spark, d):
    return shown(values(spark, d))


@query(f"{K} SELECT key, value FROM val")
def src_scan_all(spark, d):
    return shown(values(spark, d).orderBy("key"))


@query(f"{K} SELECT key, value FROM val WHERE key >= {low} AND key < {high}")
def src_range(spark, d):
    return shown(L.key_range(L.resolve(L.key_range(message_log(spark, d), key(LOW), key(HIGH))), key(LOW), key(HIGH)).orderBy("key"))


@query(f"{K} SELECT key, value FROM val WHERE key = {low}")
def src_get(spark, d):
    return shown(L.resolve(message_log(spark, d).filter(F.col("key") == key(LOW))))


@query(f"{K}, asked AS (SELECT DISTINCT printf('%016X', o_custkey % 300) AS key FROM orders) SELECT a.key, value FROM asked AS a LEFT JOIN val AS v ON a.key = v.key")
def src_multi_get(spark, d):
    asked = table(spark, d, "orders").select(by.be_encode(F.col("o_custkey") % 300).alias("key")).distinct()
    return shown(L.multi_get(values(spark, d), asked))


@query(f"{K} SELECT key, value FROM val WHERE starts_with(key, '000000000000000')")
def src_prefix(spark, d):
    # keys of seven bytes in common
    lo, hi = by.prefix_bounds(F.unhex(F.lit("00000000000000")))
    log = L.key_range(message_log(spark, d), lo, hi).filter(F.substring("key", 8, 1) < F.unhex(F.lit("10")))
    return shown(L.resolve(log))


@query("SELECT event_id AS seq, printf('%016X', user_id) AS key, printf('%08X', event_id) AS data FROM events WHERE event_type = 'signup'")
def snk_insert(spark, d):
    rows = L.checked(message_log(spark, d)).filter("op = 'I'")
    return rows.select("seq", F.hex("key").alias("key"), F.hex("data").alias("data"))


@query("SELECT event_id // 1000 AS gen, count(*) AS n_rows, count(DISTINCT user_id) AS n_keys FROM events GROUP BY 1")
def snk_sync(spark, d):
    return message_log(spark, d).groupBy("gen").agg(F.count("*").alias("n_rows"), F.countDistinct("key").alias("n_keys"))


@query(f"WITH {LOG_SQL} SELECT key, CASE WHEN arg_max(op, seq) FILTER (op IN ('I', 'D')) = 'I' THEN arg_max(data, seq) FILTER (op IN ('I', 'D')) END AS value FROM log GROUP BY key")
def agg_lww(spark, d):
    rows = message_log(spark, d).filter(F.col("op").isin("I", "D"))
    newest = L.latest(rows.withColumn("v", F.when(F.col("op") == "I", F.hex("data"))), "key", "seq", "v")
    return message_log(spark, d).select("key").distinct().join(newest, "key", "left").select(F.hex("key").alias("key"), F.col("v").alias("value"))


@query(f"WITH {LOG_SQL} SELECT key, op, count(*) AS n FROM log AS l JOIN (SELECT key AS k, max(seq) FILTER (op IN ('I', 'D')) AS s0 FROM log GROUP BY key) AS s ON k = key WHERE op <> 'D' AND seq >= coalesce(s0, -1) GROUP BY key, op")
def kv_apply(spark, d):
    return L.live_messages(message_log(spark, d)).groupBy(F.hex("key").alias("key"), "op").agg(F.count("*").alias("n"))


@query(f"{K} SELECT key, value FROM val")
def kv_merge(spark, d):
    """Compacting the older half of the log changes no value."""
    log = message_log(spark, d)
    half = middle(log)
    old = L.as_of(log, half)
    return shown(L.resolve(L.compact(old).unionByName(_deletes(old)).unionByName(log.filter(F.col("gen") > half))))


def _deletes(old: DataFrame) -> DataFrame:
    """A delete for each key of a log that has no value left."""
    gone = old.select("key").distinct().join(L.live_messages(old).select("key"), "key", "left_anti")
    null = lambda t: F.lit(None).cast(t)
    return gone.select("key", F.lit(-1).cast("long").alias("seq"), F.lit(0).cast("long").alias("gen"), F.lit("D").alias("op"), F.lit(0).alias("offset"), F.unhex(F.lit("")).alias("data"), null("int").alias("nbits"), null("boolean").alias("bit"))


@query(f"{K} SELECT key, value FROM val")
def kv_insert(spark, d):
    return shown(L.resolve(L.compact(message_log(spark, d))))


@query(f"WITH {LOG_SQL} SELECT DISTINCT key FROM log WHERE key NOT IN (SELECT key FROM log GROUP BY key HAVING arg_max(op, seq) <> 'D')")
def kv_delete(spark, d):
    """Keys whose newest message is a delete."""
    log = message_log(spark, d)
    return L.latest(log, "key", "seq", "op").filter("op = 'D'").select(F.hex("key").alias("key"))


@query(f"{K} SELECT key, value, CAST(length(value) // 2 AS INTEGER) AS size FROM val")
def kv_upsert_bytes(spark, d):
    return shown(L.resolve_by_fold(message_log(spark, d))).withColumn("size", F.expr("cast(length(value) div 2 as int)"))


BITS = """
    WITH m AS (
        SELECT printf('%016X', user_id) AS key, event_id AS seq, event_type AS t, value > 50 AS v,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id AS n
        FROM events
    ), live AS (
        SELECT m.* FROM m JOIN (SELECT key, max(seq) FILTER (t IN ('signup', 'error')) AS s0 FROM m GROUP BY key) AS s ON m.key = s.key
        WHERE t <> 'error' AND seq >= coalesce(s0, -1)
    ), size AS (
        SELECT key, max(CASE WHEN t = 'click' THEN (k + 14) // 8 WHEN t = 'signup' THEN 4 ELSE k % 16 + 4 END) AS size FROM live GROUP BY key
    ), b AS (
        SELECT key, seq, k + p AS pos, CAST(v AS INTEGER) AS o FROM live, (SELECT unnest(range(7)) AS p) AS r WHERE t = 'click'
        UNION ALL
        SELECT key, seq, 8 * (CASE WHEN t = 'signup' THEN 0 ELSE k % 16 END + p // 8) + p % 8 AS pos,
               CAST((n >> CAST(8 * (3 - p // 8) + p % 8 AS BIGINT)) & 1 AS INTEGER) AS o
        FROM live, (SELECT unnest(range(32)) AS p) AS r WHERE t <> 'click'
    ), last AS (
        SELECT key, pos, arg_max(o, seq) AS o FROM b GROUP BY key, pos
    ), byte AS (
        SELECT key, pos // 8 AS pos, sum(o * (1 << CAST(pos % 8 AS INTEGER))) AS x FROM last GROUP BY key, pos // 8
    )
    SELECT s.key, string_agg(printf('%02X', CAST(coalesce(x, 0) AS BIGINT)), '' ORDER BY g.pos) AS value
    FROM size AS s JOIN (SELECT unnest(range(128)) AS pos) AS g ON g.pos < s.size
    LEFT JOIN byte AS y ON y.key = s.key AND y.pos = g.pos GROUP BY s.key
"""


@query(BITS)
def kv_upsert_bits(spark, d):
    return shown(L.resolve(message_log(spark, d, bits=True)))


@query(f"{K} SELECT key, value FROM val WHERE key < {low} OR key >= {high}")
def kv_range_delete(spark, d):
    return shown(L.resolve(L.range_delete(message_log(spark, d), key(LOW), key(HIGH), 2**40, 2**30)))


@query(f"{K} SELECT key, value FROM val")
def kv_merge_scan(spark, d):
    log = message_log(spark, d)
    half = middle(log)
    # keys that the base has lost still have their deletes in the log above it
    return shown(L.merge_scan(L.resolve(L.as_of(log, half)), log.filter(F.col("gen") > half)))


@query(f"{K} SELECT key, value FROM val WHERE key >= {low} AND key < {high}")
def kv_apply_range(spark, d):
    log = L.key_range(message_log(spark, d), key(LOW), key(HIGH))
    half = middle(log)
    return shown(L.merge_scan(L.resolve(L.as_of(log, half)), log.filter(F.col("gen") > half)))


@query(f"{K} SELECT key, value FROM val")
def join_full_outer_merge(spark, d):
    """The older half's values and what the newer half alone gives, side by side, the newer written over."""
    log = message_log(spark, d)
    half = middle(log)
    newer = log.filter(F.col("gen") > half)
    base, touched = L.resolve(L.as_of(log, half)), newer.select("key").distinct().withColumn("new", F.lit(True))
    both = base.withColumnRenamed("value", "old").join(touched, "key", "full_outer")
    kept = both.filter("new IS NULL").select("key", F.col("old").alias("value"))
    return shown(kept.unionByName(L.merge_scan(base.join(touched, "key", "left_semi"), newer)))


def seen(spark, d) -> DataFrame:
    """The log as a snapshot in the middle of its generations sees it."""
    log = message_log(spark, d)
    return L.as_of(log, middle(log))


def _snap_sql(cond: str = "") -> str:
    return f"WITH {LOG_SQL}, seen AS (SELECT * FROM log WHERE gen <= (SELECT max(gen) // 2 FROM log)), {value_sql('seen')} SELECT key, value FROM val {cond}"


@query(_snap_sql(f"WHERE key >= {low} AND key < {high}"))
def snap_range(spark, d):
    log = seen(spark, d)
    return shown(L.resolve(L.key_range(log, key(LOW), key(HIGH))))


@query(_snap_sql(f"WHERE key = printf('%016X', 41)"))
def snap_get(spark, d):
    return shown(L.resolve(seen(spark, d).filter(F.col("key") == key(41))))


@query(_snap_sql())
def snap_open(spark, d):
    return shown(L.resolve(seen(spark, d)))


@query(f"{K} SELECT value FROM val")
def prj_kv(spark, d):
    return shown(values(spark, d)).select("value")


@query(f"WITH {LOG_SQL} SELECT key FROM log GROUP BY key HAVING arg_max(op, seq) <> 'D'")
def prj_keys(spark, d):
    """Keys alone: no value is put together."""
    return L.live_messages(message_log(spark, d)).select(F.hex("key").alias("key")).distinct()


@query(f"{K} SELECT substr(key, 15) AS rest, value FROM val")
def prj_strip_prefix(spark, d):
    v = values(spark, d)
    return v.select(F.hex(by.slice_bytes(F.col("key"), 7)).alias("rest"), F.hex("value").alias("value"))


@query("SELECT printf('%016X', doc_id) || printf('%08X', doc_id % 7) AS key, doc_id AS object_id, doc_id % 7 AS chunk_id FROM documents")
def prj_decode_chunk_key(spark, d):
    k = F.concat(by.be_encode(F.col("doc_id")), by.be_encode(F.col("doc_id") % 7, 4))
    rows = table(spark, d, "documents").select(k.alias("key"))
    return rows.select(F.hex("key").alias("key"), by.be_decode(F.substring("key", 1, 8)).alias("object_id"), by.be_decode(F.substring("key", 9, 4)).alias("chunk_id"))


@query(f"{K} SELECT key, value FROM val WHERE key > {low} AND key <= {high}")
def flt_key_range(spark, d):
    return shown(L.resolve(L.key_range(message_log(spark, d), key(LOW), key(HIGH), low_open=True, high_open=False)))


@query("SELECT p_partkey, list_contains(list_transform(range(8), lambda i: (p_partkey >> (8 * i)::INTEGER) & 255), 0) AS has_nul FROM part")
def flt_fixed_key(spark, d):
    return table(spark, d, "part").select("p_partkey", by.contains_nul(by.be_encode(F.col("p_partkey"), 8)).alias("has_nul"))


@query(f"{K} SELECT count(*) AS present FROM val")
def flt_present(spark, d):
    return values(spark, d).filter("value IS NOT NULL").agg(F.count("*").alias("present"))


@query(f"WITH {LOG_SQL} SELECT l.key, max(l.seq) AS seq FROM log AS l WHERE l.key NOT IN (SELECT key FROM log WHERE op = 'D' AND gen % 10 = 9) GROUP BY l.key")
def join_anti_deleted(spark, d):
    log = message_log(spark, d)
    gone = log.filter("op = 'D' AND gen % 10 = 9").select("key").distinct()
    return log.join(gone, "key", "left_anti").groupBy(F.hex("key").alias("key")).agg(F.max("seq").alias("seq"))


@query(f"{K} SELECT key, value FROM val ORDER BY key")
def ord_key(spark, d):
    return shown(values(spark, d).orderBy("key"))


@query(f"{K} SELECT key, value FROM val WHERE key >= {low} ORDER BY key LIMIT 20")
def ord_limit(spark, d):
    # the first keys that have a value are chosen before any value is put together
    log = L.key_range(message_log(spark, d), key(LOW))
    first = L.live_messages(log).select("key").distinct().orderBy("key").limit(20)
    return shown(L.resolve(log.join(F.broadcast(first), "key", "left_semi")).orderBy("key"))


@query(f"{K} SELECT min(key) AS key FROM val WHERE key >= {high}")
def ord_next(spark, d):
    return L.live_messages(L.key_range(message_log(spark, d), key(HIGH))).agg(F.hex(F.min("key")).alias("key"))


@query(f"{K} SELECT key, value FROM val")
def set_union_buffers(spark, d):
    log = message_log(spark, d)
    return shown(L.resolve(log.filter("seq % 2 = 0").unionByName(log.filter("seq % 2 = 1"))))


@query(f"{K} SELECT CASE WHEN key <= {high} THEN 'left' ELSE 'right' END AS side, count(*) AS n, min(key) AS low, max(key) AS high FROM val GROUP BY 1")
def set_split(spark, d):
    v = L.live_messages(message_log(spark, d)).select("key").distinct()
    side = F.when(F.col("key") <= key(HIGH), "left").otherwise("right")
    return v.groupBy(side.alias("side")).agg(F.count("*").alias("n"), F.hex(F.min("key")).alias("low"), F.hex(F.max("key")).alias("high"))


@query(f"WITH {LOG_SQL} SELECT CAST(substr(key, 14, 1) AS VARCHAR) AS range_id, count(*) AS n, min(key) AS low, max(key) AS high, CAST(sum(length(data) // 2) AS BIGINT) AS bytes FROM log GROUP BY 1")
def agg_partstats(spark, d):
    log = message_log(spark, d)
    size = F.when(F.col("op") == "D", 4).otherwise(F.length("data"))
    return log.groupBy(F.substring(F.hex("key"), 14, 1).alias("range_id")).agg(F.count("*").alias("n"), F.hex(F.min("key")).alias("low"), F.hex(F.max("key")).alias("high"), F.sum(size).cast("long").alias("bytes"))


# Orders as a metadata log: per customer, size and time only grow, the object and its preference follow the newest.
@query("""
    SELECT o_custkey AS object_key,
           arg_max(o_orderkey, o_orderkey) AS object_id,
           max(CAST(floor(o_totalprice) AS BIGINT)) AS size, max(o_orderdate) AS mtime,
           arg_max(CAST(o_orderkey % 4 AS INTEGER), o_orderkey) FILTER (o_orderkey % 3 <> 0) AS pref
    FROM orders GROUP BY o_custkey
""")
def kv_meta_merge(spark, d):
    from ..operators import objects as O

    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("object_key"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("object_id"), F.floor("o_totalprice").cast("long").alias("size"), F.col("o_orderdate").alias("mtime"), F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_orderkey") % 4).cast("int")).alias("pref"), F.lit(None).cast("int").alias("access_pattern"), F.lit("P").alias("op")
    )
    return O.fold_info(rows).select("object_key", "object_id", "size", "mtime", "pref")


QUERIES["agg_max_meta"], ORACLE_SQL["agg_max_meta"] = (lambda spark, d: kv_meta_merge(spark, d).select("object_key", "size", "mtime")), f"SELECT object_key, size, mtime FROM ({ORACLE_SQL['kv_meta_merge']})"
QUERIES["agg_latest_nonnull"], ORACLE_SQL["agg_latest_nonnull"] = (lambda spark, d: kv_meta_merge(spark, d).select("object_key", "object_id", "pref")), f"SELECT object_key, object_id, pref FROM ({ORACLE_SQL['kv_meta_merge']})"


@query("""
    SELECT e.event_id, printf('%016X', e.event_id) AS be, printf('%06X', e.event_id % 65536) || '00' AS padded,
           e.event_id % 65536 AS decoded, printf('%016X', e.user_id) || '00' || printf('%08X', e.event_id) AS meta
    FROM events AS e
""")
def fn_bytes(spark, d):
    """Big-endian numbers, zero extension and metadata keys."""
    e = table(spark, d, "events")
    short = by.be_encode(F.col("event_id") % 65536, 3)
    return e.select("event_id", F.hex(by.be_encode(F.col("event_id"))).alias("be"), F.hex(by.zero_extend(short, F.lit(4))).alias("padded"), by.be_decode(short).alias("decoded"), F.hex(by.meta_key(by.be_encode(F.col("user_id")), by.be_encode(F.col("event_id"), 4))).alias("meta"))

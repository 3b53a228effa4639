"""Queries of single functions, sources, streams, actions and allocation analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bytes as by
from ..operators import accounting as A
from ..operators import actions, telemetry
from ..operators import log as L
from ..operators.ranges import folder, sum_ahead
from ..sources import alloclog, files
from ..streaming import ingest
from . import kv, measures, space, store
from .tables import ALLOC_SQL, LOG_SQL, access_log, allocation_log, message_log, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def part(name: str, module, of: str, *columns: str):
    """Some columns of another query under a name of its own."""
    QUERIES[name] = lambda spark, d: module.QUERIES[of](spark, d).select(*columns)
    ORACLE_SQL[name] = f"SELECT {', '.join(columns)} FROM ({module.ORACLE_SQL[of]})"


part("fn_be_encode", kv, "fn_bytes", "event_id", "be")
part("fn_be_decode", kv, "fn_bytes", "event_id", "decoded")
part("fn_fill_zero", kv, "fn_bytes", "event_id", "padded")
part("fn_meta_key", kv, "fn_bytes", "event_id", "meta")
part("fn_contains_nul", kv, "flt_fixed_key", "p_partkey", "has_nul")
part("fn_size_label", measures, "fn_labels", "p_partkey", "label")
part("fn_ms_label", measures, "fn_labels", "p_partkey", "ms")
part("fn_lift", store, "fn_pref", "doc_id", "up")
part("fn_lower", store, "fn_pref", "doc_id", "down")
part("fn_faster", store, "fn_pref", "doc_id", "faster")
part("alc_free_local", space, "agg_frag", "tier", "disk", "segment", "total_free", "largest_free")


@query("SELECT event_id, substr(x, 5, 8) AS middle, substr(x, 9) AS rest, x || 'FF' AS pushed, substr(x, 1, 4) || 'AABB' || substr(x, 9) AS over, x || '00' AS low, x || '01' AS high FROM (SELECT event_id, printf('%016X', event_id) AS x FROM events)")
def fn_slice(spark, d):
    x = by.be_encode(F.col("event_id"))
    lo, hi = by.meta_bounds(x)
    over = by.overlay_at(x, F.lit(2), F.unhex(F.lit("AABB")))
    cells = {"middle": by.slice_bytes(x, 2, 4), "rest": by.slice_bytes(x, 4), "pushed": F.concat(x, F.unhex(F.lit("FF"))), "over": over, "low": lo, "high": hi}
    return table(spark, d, "events").select("event_id", *[F.hex(c).alias(n) for n, c in cells.items()])


for name, column in {"fn_push": "pushed", "fn_overlay": "over"}.items():
    QUERIES[name] = lambda spark, d, c=column: fn_slice(spark, d).select("event_id", c)
    ORACLE_SQL[name] = f"SELECT event_id, {column} FROM ({ORACLE_SQL['fn_slice']})"
QUERIES["fn_meta_bounds"], ORACLE_SQL["fn_meta_bounds"] = (lambda spark, d: fn_slice(spark, d).select("event_id", "low", "high")), f"SELECT event_id, low, high FROM ({ORACLE_SQL['fn_slice']})"


@query(f"WITH {LOG_SQL} SELECT op, count(*) AS n FROM log GROUP BY op")
def kv_insert_msg(spark, d):
    return L.checked(message_log(spark, d)).groupBy("op").agg(F.count("*").alias("n"))


COUNTED = f"WITH {LOG_SQL}, s AS (SELECT key AS k, max(seq) FILTER (op IN ('I', 'D')) AS s0 FROM log GROUP BY key) SELECT key, count(*) AS value FROM log JOIN s ON k = key WHERE op <> 'D' AND seq >= coalesce(s0, -1) GROUP BY key"


@query(COUNTED)
def kv_custom_action(spark, d):
    """A dataset whose messages count up."""
    found = actions.Aggregated(F.count("*")).resolve(message_log(spark, d))
    return found.select(F.hex("key").alias("key"), "value")


@query(COUNTED)
def kv_custom_fold(spark, d):
    def count(value, message):
        return None if message["op"] == "D" else 1 if message["op"] == "I" else (value or 0) + 1

    found = actions.Folded(count, "bigint").resolve(message_log(spark, d).select("key", "seq", "op"))
    return found.select(F.hex("key").alias("key"), "value")


@query(f"{kv.K} SELECT key, CAST(length(value) // 2 AS INTEGER) AS size FROM val")
def kv_leaf_insert(spark, d):
    """Sizes of what a compaction writes: absent keys leave no entry."""
    return L.compact(message_log(spark, d)).select(F.hex("key").alias("key"), F.length("data").alias("size"))


@query("SELECT user_id % 3 AS tier, arg_max(value, event_id) AS free, max(event_id) AS seq FROM events GROUP BY 1")
def kv_storage_info_upsert(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 3).alias("tier"), F.col("event_id").alias("seq"), F.col("value").alias("free"))
    return L.latest(e.withColumn("s", F.col("seq")), "tier", "seq", "free", "s").withColumnRenamed("s", "seq")


@query("SELECT user_id AS ds, arg_max(event_id, event_id) FILTER (event_type = 'click') AS snapshot, arg_max(event_id, event_id) FILTER (event_type <> 'click') AS ptr FROM events GROUP BY user_id")
def kv_ds_ptr_upsert(spark, d):
    """Two fields patched on their own: the newest of each wins."""
    click = F.col("event_type") == "click"
    return table(spark, d, "events").groupBy(F.col("user_id").alias("ds")).agg(F.max(F.when(click, F.col("event_id"))).alias("snapshot"), F.max(F.when(~click, F.col("event_id"))).alias("ptr"))


@query(f"WITH {LOG_SQL} SELECT key, count(*) AS n FROM log WHERE key > {kv.low} AND key <= {kv.high} GROUP BY key")
def flt_shadowed(spark, d):
    rows = L.key_range(message_log(spark, d), kv.key(kv.LOW), kv.key(kv.HIGH), low_open=True, high_open=False)
    return rows.groupBy(F.hex("key").alias("key")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM labels WHERE toxic = 0")
def obj_meta_del(spark, d):
    """Objects whose `toxic` entry is left after it was deleted where it was 1."""
    m = store.custom_metadata(spark, d).filter("name = 'toxic'")
    rows = m.withColumns({"seq": F.lit(0), "op": F.lit("I")}).unionByName(m.filter("value = '1'").withColumns({"seq": F.lit(1), "op": F.lit("D")}))
    return L.latest(rows, "key", "seq", "object_id", "op").filter("op = 'I'").select(F.col("object_id").alias("doc_id"))


@query("SELECT source AS name, min(doc_id) AS id FROM documents WHERE source IN ('src0', 'src7') GROUP BY source")
def obj_open_store(spark, d):
    return store.stores(spark, d).filter("name IN ('src0', 'src7')")


# Sources: written once, read back with their schemas.
@query("SELECT user_id % 8 + 1 AS threads, count(*) AS ops, CAST(sum(event_id) AS BIGINT) AS time_ns FROM events GROUP BY 1")
def src_csv(spark, d):
    runs = table(spark, d, "events").groupBy((F.col("user_id") % 8 + 1).cast("int").alias("threads")).agg(F.count("*").alias("ops"), F.sum("event_id").alias("time_ns"))
    path = folder(spark)
    files.write_csv(runs, path)
    return files.read_csv(spark, path, "ycsb")


@query("SELECT event_id AS epoch_ms, event_id % 3 AS free, CAST(10 AS BIGINT) AS total FROM events")
def src_jsonl(spark, d):
    path = folder(spark)
    e = table(spark, d, "events")
    files.write_jsonl(e.select(F.col("event_id").alias("epoch_ms"), F.array(F.struct((F.col("event_id") % 3).alias("free"), F.lit(10).alias("total"))).alias("usage")), path)
    return files.read_jsonl(spark, path).select("epoch_ms", F.explode("usage").alias("u")).select("epoch_ms", "u.free", "u.total")


@query(f"WITH {ALLOC_SQL} SELECT tier, count(*) AS n, CAST(sum(n) AS BIGINT) AS blocks FROM alloc WHERE op = 1 GROUP BY tier")
def snk_policy_state(spark, d):
    """Policy state as JSON lines, read back."""
    state = allocation_log(spark, d).filter("op = 1").groupBy("tier").agg(F.count("*").alias("n"), F.sum("n").alias("blocks"))
    path = folder(spark)
    files.write_jsonl(state, path)
    return files.read_jsonl(spark, path, "tier int, n bigint, blocks bigint")


RECORDS = "SELECT event_id % 2 AS op, ((user_id % 2) << 62) + ((user_id % 1024) << 52) + event_id * 17 AS off, event_id % 9 + 1 AS n FROM events"


@query(f"SELECT CAST(off >> 62 AS BIGINT) AS tier, CAST((off >> 52) & 1023 AS BIGINT) AS disk, count(*) AS n, CAST(sum(n) AS BIGINT) AS blocks, CAST(sum(off & 262143) AS BIGINT) AS places FROM ({RECORDS}) GROUP BY 1, 2")
def src_alloclog(spark, d):
    """A binary log written from events, then read back."""
    from ..functions import storage as S

    rows = table(spark, d, "events")
    off = S.pack_offset(F.col("user_id") % 2, F.col("user_id") % 1024, F.col("event_id") * 17)
    path = folder(spark)
    alloclog.write(rows.select((F.col("event_id") % 2).alias("op"), off.alias("disk_offset"), (F.col("event_id") % 9 + 1).alias("num_blocks")), path)
    return alloclog.placed(alloclog.read(spark, path)).groupBy("tier", "disk").agg(F.count("*").alias("n"), F.sum("num_blocks").alias("blocks"), F.sum("begin").alias("places"))


# Allocation analytics.
AL = f"WITH {ALLOC_SQL}"


@query(space.RUNS + " SELECT tier, CAST(sum(length) AS BIGINT) AS total_free, max(length) AS largest_free, round(1 - max(length) / sum(length), 9) AS fragmentation FROM runs GROUP BY tier")
def alc_frag_local(spark, d):
    return A.fragmentation(space.runs(spark, d), "tier").withColumn("fragmentation", F.round("fragmentation", 9))


@query(space.RUNS + " SELECT CAST(sum(length) AS BIGINT) AS total_free, max(length) AS largest_free, round(1 - max(length) / sum(length), 9) AS fragmentation FROM runs")
def alc_frag_global(spark, d):
    return A.fragmentation(space.runs(spark, d)).withColumn("fragmentation", F.round("fragmentation", 9))


QUERIES["alc_free_global"], ORACLE_SQL["alc_free_global"] = (lambda spark, d: alc_frag_global(spark, d).select("total_free", "largest_free")), f"SELECT total_free, largest_free FROM ({ORACLE_SQL['alc_frag_global']})"
CYCLES = "cy AS (SELECT user_id % 3 AS tier, event_id AS time, event_id % 7 * 100 AS own, event_id % 11 * 1000 AS total FROM events)"


def cycles(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select((F.col("user_id") % 3).alias("tier"), e.alias("time"), (e % 7 * 100).alias("own"), (e % 11 * 1000).alias("total"))


@query(f"WITH {CYCLES} SELECT tier, CAST(row_number() OVER (PARTITION BY tier ORDER BY time) AS INTEGER) AS i, own, total FROM cy WHERE own <> 0")
def alc_cycles(spark, d):
    rows = sum_ahead(cycles(spark, d).filter("own <> 0"), F.lit(1), [F.asc("time")], "tier", name="i")
    return rows.select("tier", (F.col("i") + 1).cast("int").alias("i"), "own", "total")


@query(f"WITH {CYCLES} SELECT tier, time, round(CASE WHEN total <> 0 THEN own / total END, 9) AS share FROM cy")
def alc_proportion(spark, d):
    return cycles(spark, d).select("tier", "time", F.round(F.try_divide(F.col("own").cast("double"), F.col("total")), 9).alias("share"))


@query("SELECT n_nationkey AS disk, CAST(ceil(n_nationkey * 100000 / 262144) AS BIGINT) AS segments, CAST(CASE WHEN n_nationkey = 0 THEN 0 WHEN n_nationkey * 100000 % 262144 = 0 THEN 262144 ELSE n_nationkey * 100000 % 262144 END AS INTEGER) AS last FROM nation")
def alc_storage_config(spark, d):
    """Segments of disks; the last one may be shorter."""
    blocks = F.col("n_nationkey") * 100_000
    segments = F.ceil(blocks / 262_144)
    last = F.when(blocks == 0, 0).when(blocks % 262_144 == 0, 262_144).otherwise(blocks % 262_144)
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("disk"), segments.alias("segments"), last.cast("int").alias("last"))


@query("SELECT doc_id, start, least(300, n_chars - start) AS length FROM (SELECT doc_id, n_chars, doc_id * 7919 % greatest(n_chars, 1) AS start FROM documents)")
def wl_positions(spark, d):
    """Places in objects, clamped to their size; a product stands for the random number so that runs agree."""
    rows = table(spark, d, "documents").withColumn("start", F.col("doc_id") * 7919 % F.greatest("n_chars", F.lit(1)))
    return rows.select("doc_id", "start", F.least(F.lit(300), F.col("n_chars") - F.col("start")).alias("length"))


@query("SELECT doc_id AS object_id, greatest(least(300, n_chars - start), 0) AS n FROM (SELECT doc_id, n_chars, doc_id * 7919 % greatest(n_chars, 1) AS start FROM documents)")
def wl_eval_rw(spark, d):
    from ..operators import objects as O
    from .tables import CHUNK

    own = store.objects(spark, d)
    start = F.col("object_id") * 7919 % F.greatest(F.col("size"), F.lit(1))
    return O.read_at(own, store.chunks(spark, d), start, 300, CHUNK).select("object_id", "n")


@query("SELECT user_id AS job, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean FROM events GROUP BY user_id")
def tel_fio_pct(spark, d):
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return table(spark, d, "events").groupBy(F.col("user_id").alias("job")).agg(p(0.5).alias("p50"), p(0.99).alias("p99"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT event_id // 100 AS second, user_id % 4 AS job, round(sum(value) / 1024, 6) AS bandwidth, count(*) AS iops FROM events GROUP BY 1, 2")
def tel_fio_series(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.expr("event_id div 100").alias("second"), (F.col("user_id") % 4).alias("job")).agg(F.round(F.sum("value") / 1024, 6).alias("bandwidth"), F.count("*").alias("iops"))


@query("SELECT event_id, part AS a_part, k AS a_k FROM (SELECT event_id, user_id AS part, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)")
def tel_system(spark, d):
    """Columns of a sample found by the beginning of their flat names."""
    flat = telemetry.flatten(measures.nested(spark, d), fixed={"usage": 2})
    return flat.select("event_id", *[F.col(c).alias(c.replace("cache_", "a_")) for c in flat.columns if c.startswith("cache_")])


@query("SELECT user_id AS object_id, arg_max(user_id % 3, event_id) AS tier, user_id % 3 AS grid FROM events GROUP BY user_id")
def tel_object_grid(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("object_id"), F.col("event_id").alias("seq"), (F.col("user_id") % 3).alias("tier"))
    return L.latest(e, "object_id", "seq", "tier").withColumn("grid", F.col("object_id") % 3)


# Streams over the tables, run until all is read.
@query(f"{kv.K} SELECT key, value FROM val")
def str_sync(spark, d):
    """The log committed by a stream in generations, then resolved."""
    path, src = folder(spark), folder(spark)
    message_log(spark, d).write.parquet(src)
    stream = spark.readStream.schema(L.LOG_SCHEMA).parquet(src)
    ingest.commit_stream(stream, path, f"{folder(spark)}").awaitTermination()
    return kv.shown(L.resolve(ingest.read_commits(spark, path)))


def _streamed(spark, d, make, *keys: str):
    """What a stream over accesses has counted, kept by batches in a folder: no state comes to the driver."""
    src, out = folder(spark), folder(spark)
    rows = access_log(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    ingest.keep_latest(make(stream), out, folder(spark)).awaitTermination()
    return ingest.read_latest(spark, out, *keys)


@query("SELECT user_id AS object_id, count(*) AS freq, CAST(user_id % 3 AS INTEGER) AS last_tier FROM events GROUP BY user_id")
def str_lfu_update(spark, d):
    return _streamed(spark, d, ingest.frequency_stream, "object_id")


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type")
def str_db_msgs(spark, d):
    return _streamed(spark, d, lambda s: s.groupBy("kind").agg(F.count("*").alias("n")), "kind")


@query("SELECT user_id AS object_id, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS freq FROM events GROUP BY 1, 2")
def str_windowed_frequency(spark, d):
    """Event-time windows over accesses, an addition of ours."""
    found = _streamed(spark, d, lambda s: ingest.windowed_frequency(s, "1 day", "3650 days"), "window", "object_id")
    return found.select("object_id", F.col("window.start").cast("timestamp_ntz").alias("day"), "freq")

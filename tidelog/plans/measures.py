"""Queries of telemetry and of key-value workloads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bytes as by
from ..operators import telemetry as T
from ..operators import workload as W
from .tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def named(f, name: str, sql: str | None = None):
    QUERIES[name] = f
    if sql is not None:
        ORACLE_SQL[name] = sql


# Events of a user as samples of counters.
COUNTERS = """
    c AS (
        SELECT user_id AS part, event_id AS t,
               CAST(sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) OVER w AS BIGINT) AS hits,
               CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS misses,
               CAST(sum(event_id % 100) OVER w AS BIGINT) AS blocks
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
    )"""
WIN = "WINDOW w AS (PARTITION BY part ORDER BY t)"
w = lambda: Window.partitionBy("part").orderBy("t")


def counters(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("part"), F.col("event_id").alias("t"), "event_type")
    up = w().rowsBetween(Window.unboundedPreceding, 0)
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).over(up)
    return e.select("part", "t", n(F.col("event_type").isin("view", "click")).alias("hits"), n(F.col("event_type") == "error").alias("misses"), F.sum(F.col("t") % 100).over(up).alias("blocks"))


@query(f"WITH {COUNTERS} SELECT part, t, hits - coalesce(lag(hits) OVER w, 0) AS d FROM c {WIN}")
def win_diff(spark, d):
    return counters(spark, d).select("part", "t", T.diff("hits", w()).alias("d"))


@query(f"WITH {COUNTERS} SELECT part, t, coalesce(hits - lag(hits) OVER w, 0) AS d FROM c {WIN}")
def win_diff_zero_first(spark, d):
    return counters(spark, d).select("part", "t", T.diff_zero_first("hits", w()).alias("d"))


@query(f"WITH {COUNTERS} SELECT part, t, t - first_value(t) OVER w AS since FROM c {WIN}")
def win_rel_first(spark, d):
    return counters(spark, d).select("part", "t", T.since_first("t", "part").alias("since"))


@query(f"WITH {COUNTERS} SELECT part, t, round(CAST(coalesce(blocks - lag(blocks) OVER w, 0) AS DOUBLE) * 4096 / 1024 / 1024 * 1000 / 500, 6) AS mib FROM c {WIN}")
def win_throughput(spark, d):
    return counters(spark, d).select("part", "t", F.round(T.throughput("blocks", w()), 6).alias("mib"))


@query(f"WITH {COUNTERS}, x AS (SELECT part, t, coalesce(hits - lag(hits) OVER w, 0) AS h, coalesce(misses - lag(misses) OVER w, 0) AS m FROM c {WIN}) SELECT part, t, round(CASE WHEN h + m > 0 THEN 100.0 * h / (h + m) END, 6) AS ratio FROM x")
def win_hit_ratio(spark, d):
    return counters(spark, d).select("part", "t", F.round(T.hit_ratio("hits", "misses", w()), 6).alias("ratio"))


named(lambda spark, d: counters(spark, d).groupBy("part").agg(F.max("hits").alias("hits"), F.max("misses").alias("misses"), (F.max("blocks") * 4096 / 1048576).alias("mib")), "tel_cache_series", f"WITH {COUNTERS} SELECT part, max(hits) AS hits, max(misses) AS misses, max(blocks) * 4096 / 1048576 AS mib FROM c GROUP BY part")


@query(f"WITH {COUNTERS} SELECT part, t, round(avg(blocks) OVER (PARTITION BY part ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean FROM c")
def win_moving_avg(spark, d):
    return counters(spark, d).select("part", "t", F.round(T.moving_average("blocks", 5, w()), 6).alias("mean"))


@query(f"WITH {COUNTERS} SELECT part, t, CASE WHEN b = 0 THEN 0 ELSE x // b END AS latency FROM (SELECT part, t, coalesce(misses - lag(misses) OVER w, 0) * 1000 AS x, coalesce(blocks - lag(blocks) OVER w, 0) AS b FROM c {WIN})")
def agg_read_latency(spark, d):
    x = counters(spark, d).select("part", "t", (T.diff_zero_first("misses", w()) * 1000).alias("x"), T.diff_zero_first("blocks", w()).alias("b"))
    return x.select("part", "t", F.expr("CASE WHEN b = 0 THEN 0 ELSE x div b END").alias("latency"))


@query("SELECT part, seq, rank FROM (SELECT user_id AS part, event_id AS seq, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS INTEGER) AS rank FROM events) WHERE rank <= 3")
def win_latest_read(spark, d):
    from ..operators import log as L

    e = table(spark, d, "events").select(F.col("user_id").alias("part"), F.col("event_id").alias("seq"))
    return L.ranked(e, "seq", "part").filter("rank <= 3")


@query("WITH p AS (SELECT DISTINCT l_suppkey % 10 AS part, l_shipdate AS t FROM lineitem), s AS (SELECT o_custkey % 10 AS part, o_orderdate AS t, o_orderkey AS id FROM orders), m AS (SELECT part, max(t) AS last FROM p GROUP BY part) SELECT s.part, s.t, s.id, p.t AS start FROM s ASOF JOIN p ON p.part = s.part AND p.t <= s.t JOIN m ON m.part = s.part WHERE p.t < m.last AND s.t < m.last")
def join_interval_json(spark, d):
    p = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("part"), F.col("l_shipdate").alias("t"))
    s = table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("part"), F.col("o_orderdate").alias("t"), F.col("o_orderkey").alias("id"))
    return T.interval_merge(p, s, "t", "part").select("part", "t", "id", "start")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'r' || user_id ELSE 'l' || event_id END AS v, CAST(event_id AS VARCHAR) AS t FROM events")
def fn_json_merge(spark, d):
    left = F.create_map(F.lit("t"), F.col("event_id").cast("string"), F.lit("v"), F.concat(F.lit("l"), F.col("event_id").cast("string")))
    right = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("t"), F.lit("x"), F.lit("v"), F.concat(F.lit("r"), F.col("user_id").cast("string")))).otherwise(F.create_map(F.lit("t"), F.lit("x")))
    rows = table(spark, d, "events").select("event_id", T.merge_maps(left, right, "t").alias("m"))
    return rows.select("event_id", F.col("m")["v"].alias("v"), F.col("m")["t"].alias("t"))


@query("SELECT event_id, user_id AS cache_part, CAST(json_extract_string(props, '$.k') AS INTEGER) AS cache_k, event_id % 3 AS usage_0_free, CAST(10 AS BIGINT) AS usage_0_total, event_id % 5 AS usage_1_free, CAST(20 AS BIGINT) AS usage_1_total FROM events")
def fn_json_flatten(spark, d):
    return T.flatten(nested(spark, d), fixed={"usage": 2})


def nested(spark, d):
    tier = lambda free, total: F.struct(free.alias("free"), F.lit(total).cast("long").alias("total"))
    usage = F.array(tier(F.col("event_id") % 3, 10), tier(F.col("event_id") % 5, 20))
    return table(spark, d, "events").select("event_id", F.struct(F.col("user_id").alias("part"), F.get_json_object("props", "$.k").cast("int").alias("k")).alias("cache"), usage.alias("usage"))


@query("SELECT event_id, 0 AS tier, event_id % 3 AS free, 10 - event_id % 3 AS used FROM events UNION ALL SELECT event_id, 1, event_id % 5, 20 - event_id % 5 FROM events")
def fn_explode_tiers(spark, d):
    rows = nested(spark, d).select("event_id", F.posexplode("usage").alias("tier", "u"))
    return rows.select("event_id", "tier", "u.free", (F.col("u.total") - F.col("u.free")).alias("used"))


named(lambda spark, d: fn_explode_tiers(spark, d).groupBy("tier").agg(F.sum("used").alias("used"), F.max("free").alias("free")), "tel_tier_usage", f"SELECT tier, CAST(sum(used) AS BIGINT) AS used, max(free) AS free FROM ({ORACLE_SQL['fn_explode_tiers']}) GROUP BY tier")


@query("SELECT g, CASE WHEN s <= 64000 THEN 64000 WHEN s <= 256000 THEN 256000 WHEN s <= 1000000 THEN 1000000 WHEN s <= 4000000 THEN 4000000 ELSE 1000000000 END AS bucket, min(q) AS least, quantile_cont(q, 0.25) AS q1, quantile_cont(q, 0.5) AS median, quantile_cont(q, 0.75) AS q3, max(q) AS most FROM (SELECT l_suppkey % 3 AS g, l_partkey * 500 AS s, l_quantity AS q FROM lineitem) GROUP BY 1, 2")
def agg_bucket(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 3).alias("g"), (F.col("l_partkey") * 500).alias("s"), F.col("l_quantity").alias("q"))
    return rows.groupBy("g", T.size_bucket(F.col("s")).alias("bucket")).agg(*T.box("q"))


named(lambda spark, d: agg_bucket(spark, d).select("g", "bucket", "least", "most"), "wl_filesystem", f"SELECT g, bucket, least, most FROM ({ORACLE_SQL['agg_bucket']})")


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY l_returnflag")
def agg_trend(spark, d):
    return T.trend(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", "l_returnflag").select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("SELECT l_shipmode_, n, count(*) AS c FROM (SELECT l_returnflag AS l_shipmode_, CAST(l_quantity AS INTEGER) AS n FROM lineitem) GROUP BY 1, 2")
def agg_hist(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("l_shipmode_"), F.col("l_quantity").cast("int").alias("q"))
    return T.histogram(rows, "q", "l_shipmode_").select("l_shipmode_", F.col("q").alias("n"), F.col("n").alias("c"))


@query("SELECT DISTINCT l_returnflag, l_quantity, round(cume_dist() OVER (PARTITION BY l_returnflag ORDER BY l_quantity), 9) AS share FROM lineitem")
def agg_ecdf(spark, d):
    return T.ecdf(table(spark, d, "lineitem"), "l_quantity", "l_returnflag").select("l_returnflag", "l_quantity", F.round("share", 9).alias("share"))


@query("SELECT user_id % 8 + 1 AS threads, round(count(*) / (sum(event_id) / 1e9), 4) AS ops, round(max(b) * (user_id % 8 + 1), 4) AS optimal FROM (SELECT *, (SELECT count(*) / (sum(event_id) / 1e9) FROM events WHERE user_id % 8 = 0) AS b FROM events) GROUP BY 1, user_id % 8 + 1")
def agg_throughput(spark, d):
    runs = table(spark, d, "events").groupBy((F.col("user_id") % 8 + 1).alias("threads")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ns"))
    t = W.scaling(runs)
    return t.select("threads", F.round("ops", 4).alias("ops"), F.round("optimal", 4).alias("optimal"))


named(lambda spark, d: agg_throughput(spark, d).select("threads", "ops").orderBy(F.desc("ops")), "tel_ycsb_compare", f"SELECT threads, ops FROM ({ORACLE_SQL['agg_throughput']})")


@query("SELECT user_id % 3 AS g, event_id // 1000 AS step, round(avg(user_id % 4), 6) AS tier FROM events GROUP BY 1, 2")
def agg_mean_tier(spark, d):
    return table(spark, d, "events").groupBy((F.col("user_id") % 3).alias("g"), F.expr("event_id div 1000").alias("step")).agg(F.round(F.avg(F.col("user_id") % 4), 6).alias("tier"))


@query("SELECT user_id % 3 AS tier, event_id // 1000 AS step, round(sum(value / (user_id % 100 + 1)) / count(*), 4) AS latency FROM events GROUP BY 1, 2")
def agg_mean_access_latency(spark, d):
    e = table(spark, d, "events")
    return e.groupBy((F.col("user_id") % 3).alias("tier"), F.expr("event_id div 1000").alias("step")).agg(F.round(F.sum(F.col("value") / (F.col("user_id") % 100 + 1)) / F.count("*"), 4).alias("latency"))


@query("SELECT p_partkey, CASE WHEN b >= 1000000 THEN CAST(round(b / 1000000, 1) AS VARCHAR) || 'MB' ELSE CAST(round(b / 1000, 1) AS VARCHAR) || 'KB' END AS label, printf('%d:%02d', CAST(b // 60000 AS INTEGER), CAST(b // 1000 % 60 AS INTEGER)) AS ms FROM (SELECT p_partkey, p_partkey * 1000 AS b FROM part)")
def fn_labels(spark, d):
    b = F.col("p_partkey") * 1000
    return table(spark, d, "part").select("p_partkey", by.size_label(b).alias("label"), by.ms_label(b).alias("ms"))


# Workloads: a table of operations over a table of records.
REC = "rec AS (SELECT p_partkey AS id, p_name AS value FROM part)"
KEYS, THETA = 2000, 0.99
_ZETA, _ALPHA, _ETA, _SECOND = (f"CAST('{x!r}' AS DOUBLE)" for x in W.zipf_constants(KEYS, THETA))
OPS = f"""op AS (
        SELECT event_id AS seq, event_id % 100 AS dice,
               CAST(CASE WHEN u * {_ZETA} < 1 THEN 1 WHEN u * {_ZETA} < {_SECOND} THEN 2
                         ELSE least(1 + floor({KEYS} * pow({_ETA} * u - {_ETA} + 1, {_ALPHA})), {KEYS}) END AS BIGINT) AS id
        FROM (SELECT event_id, ((event_id * 7919 + user_id) % {KEYS} + CAST('0.5' AS DOUBLE)) / {KEYS} AS u FROM events)
    )"""


def records(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("value"))


def operations(spark, d):
    """Operations on keys drawn by Zipf's law; a product stands for the random number so that runs agree."""
    u = ((F.col("event_id") * 7919 + F.col("user_id")) % KEYS + 0.5) / KEYS
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), W.zipf_rank(u, KEYS, THETA).alias("id"), (F.col("event_id") % 100).alias("dice"))


def _mixed(reads: int) -> str:
    return f"WITH {REC}, {OPS}, ver AS (SELECT id, CAST(-1 AS BIGINT) AS seq, value FROM rec UNION ALL SELECT id, seq, 'v' || seq FROM op WHERE dice >= {reads} AND id IN (SELECT id FROM rec)) SELECT r.seq, r.id, v.value FROM (SELECT * FROM op WHERE dice < {reads}) AS r ASOF LEFT JOIN ver AS v ON v.id = r.id AND v.seq <= r.seq"


@query(_mixed(50))
def wl_ycsb_a(spark, d):
    return W.mixed(records(spark, d), operations(spark, d), 50)


@query(_mixed(95))
def wl_ycsb_b(spark, d):
    return W.mixed(records(spark, d), operations(spark, d), 95)


@query(f"WITH {REC}, {OPS} SELECT seq, op.id, value FROM op LEFT JOIN rec ON rec.id = op.id")
def wl_ycsb_c(spark, d):
    return W.reads(records(spark, d), operations(spark, d))


@query(f"WITH {REC}, {OPS}, ins AS (SELECT seq, row_number() OVER (ORDER BY seq) AS k FROM op WHERE dice >= 95), n AS (SELECT count(*) AS n FROM rec), st AS (SELECT o.seq, o.id, (SELECT n FROM n) + (SELECT count(*) FROM ins WHERE ins.seq <= o.seq) AS live FROM op AS o WHERE dice < 95) SELECT seq, greatest(live - id % 10, 1) AS id FROM st")
def wl_ycsb_d(spark, d):
    return W.latest_reads(records(spark, d), operations(spark, d), 95)


@query(f"WITH {REC}, {OPS}, sc AS (SELECT seq, id AS low, seq % 100 + 1 AS n FROM op WHERE dice < 95), every_ AS (SELECT id, value, -1 AS born FROM rec UNION ALL SELECT (SELECT max(id) FROM rec) + row_number() OVER (ORDER BY seq), 'v' || seq, seq FROM op WHERE dice >= 95) SELECT seq, count(r.id) AS n, min(r.value) AS first, max(r.id) AS last FROM sc LEFT JOIN every_ AS r ON r.id >= low AND r.id < low + n AND r.born < sc.seq GROUP BY seq")
def wl_ycsb_e(spark, d):
    return W.scans(records(spark, d), operations(spark, d), 95)


@query(f"WITH {REC}, {OPS} SELECT rec.id, value || coalesce(string_agg('+' || seq, '' ORDER BY seq), '') AS value FROM rec LEFT JOIN (SELECT * FROM op WHERE dice >= 50) AS o ON o.id = rec.id GROUP BY rec.id, value")
def wl_ycsb_f(spark, d):
    return W.read_modify_write(records(spark, d), operations(spark, d), 50)


@query("SELECT event_id // 1000 AS generation, user_id % 5 AS object_num, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS bytes FROM events GROUP BY 1, 2")
def wl_checkpoints(spark, d):
    return table(spark, d, "events").groupBy(F.expr("event_id div 1000").alias("generation"), (F.col("user_id") % 5).alias("object_num")).agg(F.count("*").alias("n"), F.sum("event_id").alias("bytes"))

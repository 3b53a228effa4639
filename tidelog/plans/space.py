"""Queries of space accounting, placement policies and devices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import learning
from ..functions import storage as S
from ..operators import accounting as A
from ..operators import policy as P
from .tables import ACCESS_SQL, ALLOC_SQL, access_log, allocation_log, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}
TIER_BLOCKS, SEGMENT = 100_000, 256


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


A_ = f"WITH {ALLOC_SQL}"


def capacity(log, *by):
    return log.select(*by).distinct().withColumn("total", F.lit(TIER_BLOCKS).cast("long"))


@query(f"{A_} SELECT tier, CAST({TIER_BLOCKS} AS BIGINT) AS total, CAST({TIER_BLOCKS} + sum(CASE WHEN op = 1 THEN -n ELSE n END) AS BIGINT) AS free FROM alloc GROUP BY tier")
def agg_tier_space(spark, d):
    log = allocation_log(spark, d)
    return A.free_space(log, capacity(log, "tier"), "tier")


named(lambda spark, d: agg_tier_space(spark, d), "db_free_space", ORACLE_SQL["agg_tier_space"])


@query(f"{A_} SELECT tier, disk, CAST({TIER_BLOCKS} AS BIGINT) AS total, CAST({TIER_BLOCKS} + sum(CASE WHEN op = 1 THEN -n ELSE n END) AS BIGINT) AS free FROM alloc GROUP BY tier, disk")
def agg_disk_space(spark, d):
    log = allocation_log(spark, d)
    return A.free_space(log, capacity(log, "tier", "disk"), "tier", "disk")


@query(f"SELECT tier, free, total, round(1 - free / total, 9) AS full_, CAST(greatest(ceil(round(total * 0.05 - free, 6)), 0) AS BIGINT) AS overshoot, CAST(greatest(ceil(round(total * 0.95 - (total - free), 6)), 0) AS BIGINT) AS until FROM ({ORACLE_SQL['agg_tier_space']})")
def agg_percent_full(spark, d):
    free, total = F.col("free"), F.col("total")
    return agg_tier_space(spark, d).select("tier", "free", "total", F.round(S.percent_full(free, total), 9).alias("full_"), S.overshoot(free, total, 0.95).alias("overshoot"), S.until_filled(free, total, 0.95).alias("until"))


@query(f"SELECT tier FROM ({ORACLE_SQL['agg_tier_space']}) WHERE total > 0 AND free > 0")
def flt_tier_active(spark, d):
    return agg_tier_space(spark, d).filter("total > 0 AND free > 0").select("tier")


@query(f"{A_} SELECT tier, time, CAST(sum(CASE WHEN op = 1 THEN -n ELSE n END) OVER (PARTITION BY tier ORDER BY time) AS BIGINT) AS change FROM alloc")
def win_running_space(spark, d):
    return A.running_space(allocation_log(spark, d), "tier").select("tier", "time", "change")


SEG = "tier, disk, segment"
STATE = f"{A_}, cell AS (SELECT {SEG}, begin_ + k AS block, arg_max(op, time) AS op FROM alloc, (SELECT unnest(range(8)) AS k) AS r WHERE k < n {{cond}} GROUP BY {SEG}, begin_ + k)"


@query(STATE.format(cond="AND time <= (SELECT max(time) // 2 FROM alloc)") + f" SELECT {SEG}, block, op FROM cell")
def win_bitmap_at(spark, d):
    log = allocation_log(spark, d)
    half = (log.agg(F.max("time")).first()[0] or 0) // 2
    return A.bitmap(log.filter(F.col("time") <= half), *SEG.split(", "))


RUNS = STATE.format(cond="") + f", every_ AS (SELECT s.tier, s.disk, s.segment, b AS block, coalesce(c.op, 0) AS op FROM (SELECT DISTINCT {SEG} FROM alloc) AS s CROSS JOIN (SELECT unnest(range({SEGMENT})) AS b) AS g LEFT JOIN cell AS c ON c.tier = s.tier AND c.disk = s.disk AND c.segment = s.segment AND c.block = g.b), isle AS (SELECT {SEG}, block, block - row_number() OVER (PARTITION BY {SEG} ORDER BY block) AS g FROM every_ WHERE op = 0), runs AS (SELECT {SEG}, CAST(min(block) AS INTEGER) AS start, CAST(count(*) AS INTEGER) AS length FROM isle GROUP BY {SEG}, g)"


def runs(spark, d):
    by = SEG.split(", ")
    return A.free_runs(A.bitmap(allocation_log(spark, d), *by), SEGMENT, *by)


@query(RUNS + f" SELECT {SEG}, start, length FROM runs")
def set_bitmap_or(spark, d):
    return runs(spark, d)


@query(RUNS + f" SELECT {SEG}, CAST(sum(length) AS BIGINT) AS total_free, max(length) AS largest_free, round(1 - max(length) / sum(length), 9) AS fragmentation FROM runs GROUP BY {SEG}")
def agg_frag(spark, d):
    return A.fragmentation(runs(spark, d), *SEG.split(", ")).withColumn("fragmentation", F.round("fragmentation", 9))


@query(RUNS + f" SELECT {SEG}, min(start) AS start FROM runs WHERE length >= 10 GROUP BY {SEG}")
def win_first_fit(spark, d):
    return A.first_fit(runs(spark, d), F.lit(10), *SEG.split(", "))


named(lambda spark, d: win_first_fit(spark, d), "alloc_first_fit", ORACLE_SQL["win_first_fit"])


@query(f"{A_}, pts AS (SELECT tier, time, n AS frag FROM alloc WHERE op = 1), ask AS (SELECT tier, time FROM alloc) SELECT a.tier, a.time, p.frag FROM ask AS a ASOF LEFT JOIN pts AS p ON p.tier = a.tier AND p.time <= a.time")
def win_asof_frag(spark, d):
    log = allocation_log(spark, d)
    points, ask = log.filter("op = 1").select("tier", "time", F.col("n").alias("frag")), log.select("tier", "time")
    return A.last_known(points, ask, "time", "frag", "tier")


@query("SELECT n_nationkey % 4 AS tier, max(n_nationkey * 37 % 100) AS free, min(n_nationkey) FILTER (n_nationkey * 37 % 100 = m) AS disk FROM (SELECT *, max(n_nationkey * 37 % 100) OVER (PARTITION BY n_nationkey % 4) AS m FROM nation) GROUP BY 1")
def ord_max_disk(spark, d):
    disks = table(spark, d, "nation").select((F.col("n_nationkey") % 4).alias("tier"), F.col("n_nationkey").alias("disk"), (F.col("n_nationkey") * 37 % 100).alias("free"))
    return A.choose_disk(disks, "tier")


named(lambda spark, d: ord_max_disk(spark, d), "alloc_choose_disk", ORACLE_SQL["ord_max_disk"])


@query("WITH st AS (SELECT * FROM (VALUES (0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 2), (2, 0, 2), (3, 0, 3)) AS v(pref, pos, class)), fr AS (SELECT * FROM (VALUES (0, 10), (1, 25), (2, 40)) AS v(class, free)) SELECT p_partkey AS id, arg_min(st.class, pos) FILTER (free >= p_size) AS class FROM part LEFT JOIN st ON st.pref = p_partkey % 4 LEFT JOIN fr ON fr.class = st.class GROUP BY p_partkey")
def fn_alloc_strategy(spark, d):
    strategy = spark.createDataFrame([(0, [0, 1]), (1, [1, 2]), (2, [2]), (3, [3])], "pref int, classes array<int>")
    free = spark.createDataFrame([(0, 10), (1, 25), (2, 40)], "class int, free int")
    requests = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 4).cast("int").alias("pref"), F.col("p_size").alias("need"))
    return A.choose_class(requests, strategy, free)


@query("SELECT event_id, off, t AS tier, dk AS disk, b AS block, off & ~CAST(262143 AS BIGINT) AS segment, off & 262143 AS place FROM (SELECT event_id, user_id % 2 AS t, user_id % 1024 AS dk, event_id * 65537 AS b, ((user_id % 2) << 62) + ((user_id % 1024) << 52) + event_id * 65537 AS off FROM events)")
def fn_disk_offset(spark, d):
    off = S.pack_offset(F.col("user_id") % 2, F.col("user_id") % 1024, F.col("event_id") * 65537)
    rows = table(spark, d, "events").select("event_id", off.alias("off"))
    o = F.col("off")
    return rows.select("event_id", "off", S.offset_tier(o).alias("tier"), S.offset_disk(o).alias("disk"), S.offset_block(o).alias("block"), S.segment_of(o).alias("segment"), S.in_segment(o).alias("place"))


named(lambda spark, d: fn_disk_offset(spark, d).select("event_id", "segment", "place"), "fn_segment", f"SELECT event_id, segment, place FROM ({ORACLE_SQL['fn_disk_offset']})")


@query("SELECT event_id, CASE WHEN (event_id * 65537 & ~CAST(262143 AS BIGINT)) + 262144 >= 400000000 THEN 0 ELSE (event_id * 65537 & ~CAST(262143 AS BIGINT)) + 262144 END AS next_ FROM events")
def fn_next_segment(spark, d):
    return table(spark, d, "events").select("event_id", S.next_segment(F.col("event_id") * 65537, F.lit(400000000)).alias("next_"))


@query("SELECT p_partkey, CAST((p_size * 1000 + 4095) // 4096 AS BIGINT) AS blocks, CAST(p_size + (p_size - 1) // 3 + 1 AS BIGINT) AS parity, CAST(p_size * 3 // 4 AS BIGINT) AS free, (p_partkey * 1000003 >> 25) % 3 AS replica, p_partkey & 1 AS slot FROM part")
def fn_devices(spark, d):
    n = F.col("p_size").cast("long")
    return table(spark, d, "part").select("p_partkey", S.blocks_for(n * 1000).alias("blocks"), S.parity_blocks(n, F.lit(4)).alias("parity"), S.parity_free(n, F.lit(4)).alias("free"), S.mirror_start(F.col("p_partkey") * 1000003, F.lit(3)).alias("replica"), S.superblock_slot(F.col("p_partkey")).alias("slot"))


for name, columns in {"fn_block_round": "blocks", "fn_parity_size": "parity", "fn_effective_free": "free", "fn_mirror_start": "replica", "fn_superblock_slot": "slot"}.items():
    named(lambda spark, d, c=columns: fn_devices(spark, d).select("p_partkey", c), name, f"SELECT p_partkey, {columns} FROM ({ORACLE_SQL['fn_devices']})")


@query("SELECT user_id % 3 AS device, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS read_, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS written, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM events GROUP BY 1")
def agg_vdev_stats(spark, d):
    e = table(spark, d, "events")
    return e.groupBy((F.col("user_id") % 3).alias("device")).agg(F.count_if(F.col("event_type") == "view").alias("read_"), F.count_if(F.col("event_type") == "click").alias("written"), F.count_if(F.col("event_type") == "error").alias("failed"))


@query("SELECT user_id AS part, count(*) FILTER (event_type <> 'error') AS hits, count(*) FILTER (event_type = 'error') AS misses, round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 6) AS hit_percent FROM events GROUP BY user_id")
def agg_cache_stats(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("part")).agg(F.count_if(F.col("event_type") != "error").alias("hits"), F.count_if(F.col("event_type") == "error").alias("misses"), F.count("*").alias("size"), F.countDistinct("event_type").alias("entries"))
    return A.cache_ratios(e).select("part", "hits", "misses", F.round("hit_percent", 6).alias("hit_percent"))


@query("SELECT l_orderkey AS block, min(CASE WHEN l_discount < 0.08 THEN l_linenumber END) AS replica, count(*) FILTER (l_discount >= 0.08) AS faulted, CAST(CASE WHEN min(l_discount) < 0.08 THEN count(*) FILTER (l_discount >= 0.08) ELSE 0 END AS BIGINT) AS repaired FROM lineitem GROUP BY l_orderkey")
def join_mirror_replicas(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("block"), F.col("l_linenumber").alias("replica"), (F.col("l_discount") < 0.08).alias("ok"))
    return A.choose_replica(rows)


named(lambda spark, d: join_mirror_replicas(spark, d).agg(F.sum("faulted").alias("faulted"), F.sum("repaired").alias("repaired")), "agg_scrub", f"SELECT CAST(sum(faulted) AS BIGINT) AS faulted, CAST(sum(repaired) AS BIGINT) AS repaired FROM ({ORACLE_SQL['join_mirror_replicas']})")
named(lambda spark, d: join_mirror_replicas(spark, d).filter("faulted > 0"), "vdev_scrub", f"SELECT * FROM ({ORACLE_SQL['join_mirror_replicas']}) WHERE faulted > 0")


@query("SELECT l_orderkey AS stripe, bit_xor(l_partkey) AS parity FROM lineitem GROUP BY l_orderkey")
def agg_parity(spark, d):
    return A.parity(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stripe"), F.col("l_partkey").alias("value")), "stripe")


@query("SELECT c_custkey, min(CASE WHEN o_orderkey % 5 = 4 THEN 254 ELSE CAST(o_orderkey % 5 AS INTEGER) END) AS pref FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def agg_pref_min(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pref = F.when(F.col("o_orderkey") % 5 == 4, S.NONE).otherwise((F.col("o_orderkey") % 5).cast("int"))
    return o.groupBy("c_custkey").agg(F.min(pref).alias("pref"))


X = f"WITH {ACCESS_SQL}, obj AS (SELECT object_id, count(*) AS freq, max(tier) AS tier, max(size) AS size FROM access GROUP BY object_id)"


def hot_objects(spark, d):
    return P.frequencies(access_log(spark, d), "tier", "size")


@query(X + " SELECT object_id, freq, tier, size FROM obj")
def agg_freq(spark, d):
    return hot_objects(spark, d)


@query(X + " SELECT object_id, freq FROM obj ORDER BY freq DESC, object_id LIMIT 10")
def ord_topk_freq(spark, d):
    return hot_objects(spark, d).orderBy(F.desc("freq"), "object_id").limit(10).select("object_id", "freq")


@query(X + ", r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY tier ORDER BY freq DESC, object_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM obj) SELECT object_id, tier, freq, CAST(b AS BIGINT) AS before FROM r WHERE b < 500")
def win_mfu_topk(spark, d):
    return P.until_full(hot_objects(spark, d), F.lit(500), [F.desc("freq"), F.asc("object_id")], "tier").select("object_id", "tier", "freq", "before")


@query(X + ", r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY tier ORDER BY freq, object_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM obj) SELECT object_id, tier, freq, CAST(b AS BIGINT) AS before FROM r WHERE b < 500")
def win_lfu_demote(spark, d):
    return P.until_full(hot_objects(spark, d), F.lit(500), [F.asc("freq"), F.asc("object_id")], "tier").select("object_id", "tier", "freq", "before")


def tight(spark):
    return spark.createDataFrame([(0, True), (1, False), (2, False)], "tier int, tight boolean")


@query(X + ", c AS (SELECT tier + 1 AS tier, min(freq) AS cold FROM obj GROUP BY tier), ok AS (SELECT o.* FROM obj AS o LEFT JOIN c ON c.tier = o.tier WHERE o.tier > 0 AND (o.tier <> 1 OR coalesce(cold, 0) < freq)), r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY tier ORDER BY freq DESC, object_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM ok) SELECT object_id, tier, CAST(tier - 1 AS INTEGER) AS target FROM r WHERE b < 700")
def pol_lfu_promote(spark, d):
    return P.promote(hot_objects(spark, d), tight(spark), 700)


@query(X + ", w AS (SELECT * FROM (VALUES (0, 300), (1, 900)) AS v(tier, desired)), r AS (SELECT o.*, desired, coalesce(sum(size) OVER (PARTITION BY o.tier ORDER BY freq, object_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM obj AS o JOIN w ON w.tier = o.tier) SELECT object_id, tier, CAST(tier + 1 AS INTEGER) AS target FROM r WHERE b < desired")
def pol_lfu_demote(spark, d):
    return P.demote(hot_objects(spark, d), spark.createDataFrame([(0, 300), (1, 900)], "tier int, desired int"))


@query(X + ", target AS (SELECT object_id, tier, CASE WHEN freq % 2 = 0 AND tier > 0 THEN tier - 1 END AS t FROM obj) SELECT object_id, CAST(coalesce(t, tier) AS INTEGER) AS tier FROM target")
def join_location_move(spark, d):
    """Where objects are after moves: the newest record of each wins."""
    from ..operators import log as L

    o = hot_objects(spark, d)
    now = o.select("object_id", F.lit(0).alias("seq"), "tier")
    moves = o.filter("freq % 2 = 0 AND tier > 0").select("object_id", F.lit(1).alias("seq"), (F.col("tier") - 1).alias("tier"))
    return L.latest(now.unionByName(moves), "object_id", "seq", "tier")


named(lambda spark, d: join_location_move(spark, d), "kv_migrate", ORACLE_SQL["join_location_move"])


@query("WITH t AS (SELECT * FROM (VALUES (0, 20, 1000), (1, 400, 1000), (2, 10, 1000), (3, 900, 1000)) AS v(tier, free, total)), f AS (SELECT *, 1 - free / total AS u, lead(1 - free / total) OVER (ORDER BY tier) AS lo FROM t) SELECT tier, u >= 0.95 AS tight, u > 0.95 AND lo < 0.95 AS demote, CAST(CASE WHEN u > 0.95 AND lo < 0.95 THEN 50 - free ELSE 0 END AS BIGINT) AS desired FROM f WHERE lo IS NOT NULL")
def pol_loop_thresholds(spark, d):
    return P.threshold_plan(spark.createDataFrame([(0, 20, 1000), (1, 400, 1000), (2, 10, 1000), (3, 900, 1000)], "tier int, free int, total int"))


HOT = X + ", hot AS (SELECT object_id, tier, size, CAST(freq AS DOUBLE) / 100 AS hot FROM obj)"


def temperatures(spark, d):
    return hot_objects(spark, d).select("object_id", "tier", "size", (F.col("freq").cast("double") / 100).alias("hot"))


@query(HOT + ", s AS (SELECT tier, avg(hot) AS s1, avg(hot * size) AS s2 FROM hot GROUP BY tier), r AS (SELECT tier, CAST(sum(rt) AS BIGINT) AS s3, count(*) AS n FROM access GROUP BY tier) SELECT s.tier, round(s1, 6) AS s1, round(s2, 6) AS s2, s3, n AS n_requests, round(s3 / n, 6) AS reward FROM s JOIN r ON r.tier = s.tier")
def agg_tier_state(spark, d):
    s = P.tier_states(temperatures(spark, d), access_log(spark, d))
    return s.select("tier", F.round("s1", 6).alias("s1"), F.round("s2", 6).alias("s2"), "s3", "n_requests", F.round("reward", 6).alias("reward"))


@query(f"WITH {ACCESS_SQL}, r AS (SELECT tier, rt, row_number() OVER (PARTITION BY tier ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY tier) AS n FROM access) SELECT tier, round(sum(rt * exp(-0.05 * i / n)) / max(n), 4) AS reward FROM r GROUP BY tier")
def agg_reward(spark, d):
    return P.decayed_reward(access_log(spark, d)).select("tier", F.round("reward", 4).alias("reward"))


@query(HOT + " SELECT tier, object_id, hot FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY hot, object_id) AS k FROM hot) WHERE k = 1")
def win_coldest(spark, d):
    return P.coldest(temperatures(spark, d))


@query(HOT + ", s AS (SELECT tier, sum(hot) AS h, sum(hot * size) AS hs, count(*) AS n FROM hot GROUP BY tier) SELECT object_id, hot.tier, round(CASE WHEN n > 1 THEN (h - hot) / (n - 1) ELSE 0 END, 6) AS s1_not, round(CASE WHEN n > 1 THEN (hs - hot * size) / (n - 1) ELSE 100000 END, 6) AS s2_not FROM hot JOIN s ON s.tier = hot.tier")
def fn_loo_state(spark, d):
    return P.leave_one_out(temperatures(spark, d)).select("object_id", "tier", F.round("s1_not", 6).alias("s1_not"), F.round("s2_not", 6).alias("s2_not"))


@query(HOT + " SELECT object_id, round(1 / (1 + 2 * exp(-0.5 * hot)), 9) AS large, round(0.8 * hot + 0.2 * size, 9) AS temp FROM hot")
def fn_logistic(spark, d):
    hot = F.col("hot")
    return temperatures(spark, d).select("object_id", F.round(learning.logistic(hot, 2.0, 0.5), 9).alias("large"), F.round(learning.temperature(hot, F.col("size")), 9).alias("temp"))


named(lambda spark, d: fn_logistic(spark, d).select("object_id", "temp"), "fn_temp_update", f"SELECT object_id, temp FROM ({ORACLE_SQL['fn_logistic']})")
COST_A, COST_B, COST_P = [1.0, 2.0, 3.0], [0.5, 0.01, 0.0001], [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
_l = [f"(1 / (1 + {a} * exp(-{b} * {s})))" for a, b, s in zip(COST_A, COST_B, ("s1", "s2", "s3"))]
_terms = [f"{COST_P[4 * x + 2 * y + z]} * " + " * ".join(v if k else f"(1 - {v})" for v, k in zip(_l, (x, y, z))) for x in (0, 1) for y in (0, 1) for z in (0, 1)]


@query(f"SELECT tier, round({' + '.join(_terms)}, 6) AS cost FROM ({ORACLE_SQL['agg_tier_state']})")
def fn_fuzzy_cost(spark, d):
    state = [F.col(c) for c in ("s1", "s2", "s3")]
    return agg_tier_state(spark, d).select("tier", F.round(learning.fuzzy_cost(state, COST_A, COST_B, COST_P), 6).alias("cost"))


@query(HOT + ", s AS (SELECT tier, sum(hot) AS h, count(*) AS n FROM hot GROUP BY tier) SELECT object_id, hot.tier, (u.h + hot) / (u.n + 1) + CASE WHEN s.n > 1 THEN (s.h - hot) / (s.n - 1) ELSE 0 END > u.h / u.n + s.h / s.n AS up FROM hot JOIN s ON s.tier = hot.tier JOIN s AS u ON u.tier = hot.tier - 1")
def fn_cost_compare(spark, d):
    """Whether the mean temperatures of both tiers together rise if an object moves up."""
    o = temperatures(spark, d)
    s = o.groupBy("tier").agg(F.sum("hot").alias("h"), F.count("*").alias("n"))
    upper = F.broadcast(s.select((F.col("tier") + 1).alias("tier"), F.col("h").alias("uh"), F.col("n").alias("un")))
    rows = o.join(F.broadcast(s), "tier").join(upper, "tier")
    moved = learning.joined_by(F.col("uh"), F.col("un"), F.col("hot")) + learning.without(F.col("h"), F.col("n"), F.col("hot"), 0.0)
    return rows.select("object_id", "tier", (moved > F.col("uh") / F.col("un") + F.col("h") / F.col("n")).alias("up"))


@query()
def fn_td_learn(spark, d):
    """Cost weights learned over days of accesses; tests compare them with a plain loop."""
    a = access_log(spark, d).withColumn("step", F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")))
    steps = a.groupBy("tier", "step").agg((F.countDistinct("object_id") / 100).alias("s1"), F.avg(F.col("size").cast("double")).alias("s2"), F.avg(F.col("rt").cast("double") / 1e4).alias("s3"), F.avg(F.col("rt") / 1e4).alias("reward"))
    return P.td_learn(steps, COST_A, COST_B, COST_P)


@query(f"WITH {ACCESS_SQL}, u AS (SELECT tier, seq, lag(seq) OVER (PARTITION BY tier, object_id ORDER BY seq) AS b FROM access) SELECT CAST(tier AS BIGINT) AS part, count(*) FILTER (seq - b <= 100) AS hits, count(*) FILTER (b IS NULL OR seq - b > 100) AS misses, count(*) FILTER (seq - b > 100) AS evictions FROM u GROUP BY tier")
def cache_clock(spark, d):
    """Hits and misses of a cache per tier that keeps what was used within the last 100 steps."""
    a = access_log(spark, d)
    return P.reuse_cache(a.select(F.col("tier").cast("long").alias("part"), "seq", F.col("object_id").alias("key")), 100)


@query(f"WITH {ACCESS_SQL} SELECT tier, count(DISTINCT object_id) AS objects, count(*) AS requests, CAST(sum(rt) AS BIGINT) AS rt, CAST(sum(size) AS BIGINT) AS bytes FROM access WHERE kind IN ('view', 'click') GROUP BY tier")
def pol_rl_update(spark, d):
    """What the learned policy takes from a batch of accesses."""
    a = access_log(spark, d).filter(F.col("kind").isin("view", "click"))
    return a.groupBy("tier").agg(F.countDistinct("object_id").alias("objects"), F.count("*").alias("requests"), F.sum("rt").alias("rt"), F.sum("size").alias("bytes"))

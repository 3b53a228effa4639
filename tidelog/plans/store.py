"""Queries of the object layer and of the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bytes as by
from ..functions import chunks as C
from ..functions import storage as S
from ..operators import catalog as K
from ..operators import objects as O
from .tables import CHUNK, CHUNKS_SQL, OBJECTS_SQL, chunks, objects, table

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


B = f"WITH {OBJECTS_SQL}, {CHUNKS_SQL}"


@query(f"{B} SELECT object_id, object_key, size FROM objects")
def src_iter_objects(spark, d):
    return objects(spark, d)


@query(f"{B} SELECT object_key, object_id, size FROM objects WHERE object_key >= 'doc-00000100' AND object_key < 'doc-00000200'")
def src_meta_scan(spark, d):
    return objects(spark, d).filter("object_key >= 'doc-00000100' AND object_key < 'doc-00000200' AND position(char(0), object_key) = 0").select("object_key", "object_id", "size")


@query("SELECT 'quality' AS name, CAST(quality AS VARCHAR) AS value FROM labels WHERE doc_id = 24 UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR) FROM labels WHERE doc_id = 24")
def src_iter_metadata(spark, d):
    """Custom metadata of one object, its keys without the object's prefix."""
    return custom_metadata(spark, d).filter("object_key = 'doc-00000024'").select(F.substring_index("key", "/", -1).alias("name"), "value")


def custom_metadata(spark, d):
    rows = table(spark, d, "labels").select(F.format_string("doc-%08d", "doc_id").alias("object_key"), "doc_id", F.expr("stack(2, 'quality', quality, 'toxic', toxic) AS (name, v)"))
    return rows.select("object_key", F.col("doc_id").alias("object_id"), F.concat_ws("/", "object_key", "name").alias("key"), "name", F.col("v").cast("string").alias("value"))


@query(f"{B} SELECT object_id, chunk_id, chunk_id * 128 AS start, chunk_id * 128 + length(data) AS end FROM chunks WHERE chunk_id >= 1 AND chunk_id < 5")
def src_chunks(spark, d):
    return O.chunk_ranges(chunks(spark, d), 1, 5, CHUNK)


READ = """
    , ask AS (
        SELECT object_id, greatest(least(400, size - 100), 0) AS n FROM objects
    ), part AS (
        SELECT object_id, n, c, greatest(100, c * 128) - c * 128 AS b, least(100 + n, c * 128 + 128) - c * 128 AS e
        FROM ask, (SELECT unnest(range(4)) AS c) AS r WHERE n > 0 AND c * 128 < 100 + n
    )
    SELECT a.object_id, CAST(a.n AS BIGINT) AS n,
           coalesce(string_agg(rpad(substr(coalesce(k.data, ''), CAST(b + 1 AS BIGINT), CAST(e - b AS BIGINT)), CAST(e - b AS INTEGER), '0'), '' ORDER BY c), '') AS data
    FROM ask AS a LEFT JOIN part AS p ON p.object_id = a.object_id
    LEFT JOIN chunks AS k ON k.object_id = p.object_id AND k.chunk_id = p.c GROUP BY a.object_id, a.n
"""


@query(B + READ)
def obj_read_at(spark, d):
    return O.read_at(objects(spark, d), chunks(spark, d), 100, 400, CHUNK)


named(lambda spark, d: O.read_at(objects(spark, d), chunks(spark, d), 100, 400, CHUNK).select("object_id", "n"), "join_object_chunks", f"SELECT object_id, n FROM ({B + READ})")


WRITES = "w AS (SELECT doc_id AS object_id, doc_id AS seq, doc_id % 300 AS off, coalesce(text, '') AS data FROM documents)"


def writes(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("object_id"), F.col("doc_id").alias("seq"), (F.col("doc_id") % 300).alias("offset"), F.coalesce("text", F.lit("")).alias("data"))


@query(f"WITH {WRITES} SELECT object_id, CAST(c AS BIGINT) AS chunk_id, greatest(off, c * 128) - c * 128 AS begin, substr(data, CAST(greatest(off, c * 128) - off + 1 AS BIGINT), CAST(least(off + length(data), c * 128 + 128) - greatest(off, c * 128) AS BIGINT)) AS data FROM (SELECT *, unnest(range(off // 128, (off + length(data) - 1) // 128 + 1)) AS c FROM w WHERE length(data) > 0)")
def obj_write_at(spark, d):
    return O.write_chunks(writes(spark, d), CHUNK).select("object_id", "chunk_id", "begin", "data")


@query(f"WITH {WRITES} SELECT object_id, off + length(data) AS size FROM w")
def obj_info(spark, d):
    return O.grown_sizes(writes(spark, d))


@query("SELECT doc_id, CAST(CASE WHEN n_chars > 0 THEN (doc_id * 1000 + n_chars - 1) // 131072 - doc_id * 1000 // 131072 + 1 ELSE 0 END AS BIGINT) AS n, doc_id * 1000 // 131072 AS chunk, doc_id * 1000 % 131072 AS place FROM documents")
def agg_chunk_count(spark, d):
    rows = table(spark, d, "documents")
    at = F.col("doc_id") * 1000
    return rows.select("doc_id", C.chunk_count(at, F.col("n_chars")).alias("n"), C.chunk_of(at).alias("chunk"), C.in_chunk(at).alias("place"))


named(lambda spark, d: agg_chunk_count(spark, d).select("doc_id", "chunk", "place"), "fn_chunk_of", f"SELECT doc_id, chunk, place FROM ({ORACLE_SQL['agg_chunk_count']})")


@query("SELECT doc_id, CAST(c AS BIGINT) AS chunk_id, CAST(greatest(doc_id * 1000, c * 4096) - c * 4096 AS BIGINT) AS begin, CAST(least(doc_id * 1000 + n_chars, c * 4096 + 4096) - c * 4096 AS BIGINT) AS end FROM (SELECT doc_id, n_chars, unnest(range(doc_id * 1000 // 4096, (doc_id * 1000 + n_chars - 1) // 4096 + 1)) AS c FROM documents WHERE n_chars > 0)")
def fn_chunk_split(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(C.chunk_split(F.col("doc_id") * 1000, F.col("n_chars"), 4096)).alias("c"))
    return rows.select("doc_id", "c.*")


named(lambda spark, d: fn_chunk_split(spark, d).select("doc_id", (F.col("chunk_id") * 4096 + F.col("begin")).alias("start")), "fn_chunk_bytes", f"SELECT doc_id, chunk_id * 4096 + begin AS start FROM ({ORACLE_SQL['fn_chunk_split']})")


@query(f"{B} SELECT object_id, prev AS start, start AS end FROM (SELECT object_id, chunk_id * 128 AS start, coalesce(lag(chunk_id * 128 + length(data)) OVER (PARTITION BY object_id ORDER BY chunk_id), 0) AS prev FROM chunks) WHERE start > prev")
def win_gap_fill(spark, d):
    return O.holes(chunks(spark, d), CHUNK)


@query(f"{B} SELECT o.object_id, o.size, CAST(coalesce(sum(length(data)), 0) AS BIGINT) AS stored FROM objects AS o LEFT JOIN chunks AS c ON c.object_id = o.object_id GROUP BY o.object_id, o.size")
def agg_obj_size_vs_alloc(spark, d):
    return O.allocated(objects(spark, d), chunks(spark, d))


@query(f"{B}, names AS (SELECT DISTINCT printf('doc-%08d', o_custkey) AS k FROM orders), top AS (SELECT max(object_id) AS t FROM objects) SELECT k AS object_key, t + row_number() OVER (ORDER BY k) AS object_id FROM names, top WHERE k NOT IN (SELECT object_key FROM objects)")
def obj_create(spark, d):
    names = table(spark, d, "orders").select(F.format_string("doc-%08d", "o_custkey").alias("object_key")).distinct()
    return O.create(objects(spark, d), names)


@query(f"{B} SELECT object_key, object_id, size FROM objects WHERE object_key = 'doc-00000007'")
def obj_open(spark, d):
    return objects(spark, d).filter("object_key = 'doc-00000007'").select("object_key", "object_id", "size")


@query(f"{B}, names AS (SELECT DISTINCT printf('doc-%08d', o_custkey) AS object_key FROM orders) SELECT n.object_key, o.object_id, o.object_id IS NULL AS created FROM names AS n LEFT JOIN objects AS o ON o.object_key = n.object_key")
def obj_open_or_create(spark, d):
    names = table(spark, d, "orders").select(F.format_string("doc-%08d", "o_custkey").alias("object_key")).distinct()
    return names.join(objects(spark, d), "object_key", "left").select("object_key", "object_id", F.col("object_id").isNull().alias("created"))


@query(f"{B}, m AS (SELECT doc_id FROM labels) SELECT 'objects' AS part, count(*) AS n FROM objects WHERE object_id % 10 <> 0 UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE object_id % 10 <> 0 UNION ALL SELECT 'metadata', 2 * count(*) FROM m WHERE doc_id % 10 <> 0")
def obj_delete(spark, d):
    own = objects(spark, d)
    parts = O.delete(own, chunks(spark, d), custom_metadata(spark, d), own.filter("object_id % 10 = 0").select("object_id"))
    counted = [p.agg(F.lit(n).alias("part"), F.count("*").alias("n")) for n, p in zip(("objects", "chunks", "metadata"), parts, strict=True)]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query(f"{B} SELECT CASE WHEN object_key = 'doc-00000007' THEN 'doc-00000009' ELSE object_key END AS object_key, object_id, size FROM objects WHERE object_key <> 'doc-00000009'")
def obj_rename(spark, d):
    return O.rename(objects(spark, d), F.lit("doc-00000007"), F.lit("doc-00000009")).select("object_key", "object_id", "size")


@query(f"{B} SELECT object_id, size + 10 AS from_end, CASE WHEN 100 + object_id >= 0 THEN 100 + object_id END AS from_current, CASE WHEN object_id - 50 >= 0 THEN object_id - 50 END AS from_start FROM objects")
def obj_seek(spark, d):
    at, size, step = F.lit(100), F.col("size"), F.col("object_id")
    return objects(spark, d).select("object_id", O.seek(at, size, "end", F.lit(10)).alias("from_end"), O.seek(at, size, "current", step).alias("from_current"), O.seek(at, size, "start", step - 50).alias("from_start"))


@query(f"WITH {WRITES} SELECT object_id, object_id % 64 AS cursor, CAST(coalesce(sum(length(data)) OVER (PARTITION BY object_id % 64 ORDER BY object_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position FROM w")
def obj_cursor(spark, d):
    """Where each of 64 cursors stands before each of its writes."""
    from ..operators.ranges import sum_ahead

    rows = writes(spark, d).select("object_id", (F.col("object_id") % 64).alias("cursor"), F.length("data").alias("n"))
    return sum_ahead(rows, F.col("n"), [F.asc("object_id")], "cursor", name="position").drop("n")


@query("SELECT printf('doc-%08d', doc_id) AS object_key, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic FROM labels")
def obj_meta_get(spark, d):
    m = custom_metadata(spark, d).groupBy("object_key").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("m"))
    return m.select("object_key", F.col("m")["quality"].alias("quality"), F.col("m")["toxic"].alias("toxic"))


@query("SELECT printf('doc-%08d', doc_id) AS object_key, count(*) AS n FROM (SELECT doc_id FROM labels WHERE toxic = 0 UNION ALL SELECT doc_id FROM labels) GROUP BY doc_id")
def obj_meta_set(spark, d):
    """Entries of each object after `toxic` was set, and taken away where it was 1: the newest message of a name wins."""
    from ..operators import log as L

    m = custom_metadata(spark, d).withColumns({"seq": F.lit(0), "op": F.lit("I")})
    gone = m.filter("name = 'toxic' AND value = '1'").withColumns({"seq": F.lit(1), "op": F.lit("D")})
    last = L.latest(m.unionByName(gone), "key", "seq", "object_key", "op")
    return last.filter("op = 'I'").groupBy("object_key").agg(F.count("*").alias("n"))


TIERS = "t AS (SELECT * FROM (VALUES (0, 800), (1, 3000), (2, 100000)) AS v(tier, free))"


@query(f"WITH {TIERS} SELECT doc_id AS object_id, CAST(doc_id % 3 AS INTEGER) AS tier, CAST(doc_id % 5 AS INTEGER) AS target, n_chars AS size, CASE WHEN free IS NULL THEN 'no such tier' WHEN doc_id % 3 = doc_id % 5 THEN 'same tier' WHEN n_chars > free THEN 'too large' ELSE 'moved' END AS status FROM documents LEFT JOIN t ON t.tier = doc_id % 5")
def obj_migrate(spark, d):
    tiers = spark.createDataFrame([(0, 800), (1, 3000), (2, 100000)], "tier int, free int")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("object_id"), (F.col("doc_id") % 3).cast("int").alias("tier"), F.col("n_chars").alias("size"))
    return O.migrate(rows, tiers, F.col("object_id") % 5)


PREF = "CASE doc_id % 5 WHEN 4 THEN 254 ELSE CAST(doc_id % 5 AS INTEGER) END"


@query(f"SELECT doc_id, CASE WHEN p <> 254 THEN greatest(p - 1, 0) END AS up, CASE WHEN p <> 254 THEN least(p + 1, 3) END AS down, CASE WHEN p = 254 THEN q ELSE p END AS either, least(p, q) AS faster, CASE q WHEN 0 THEN 'Fastest' WHEN 1 THEN 'Fast' WHEN 2 THEN 'Slow' END AS name FROM (SELECT doc_id, {PREF} AS p, CAST(doc_id % 3 AS INTEGER) AS q FROM documents)")
def fn_pref(spark, d):
    p = F.when(F.col("doc_id") % 5 == 4, S.NONE).otherwise((F.col("doc_id") % 5).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", p.alias("p"), (F.col("doc_id") % 3).cast("int").alias("q"))
    p, q = F.col("p"), F.col("q")
    return rows.select("doc_id", S.lift(p).alias("up"), S.lower(p).alias("down"), S.pref_or(p, q).alias("either"), S.faster(p, q).alias("faster"), S.tier_name(q).alias("name"))


for name, columns in {"obj_migrate_up": ["up"], "obj_migrate_down": ["down"], "fn_pref_or": ["either"], "fn_pref_faster": ["faster"], "fn_weak_bound": ["faster"], "fn_tier_name": ["name"]}.items():
    named(lambda spark, d, columns=columns: fn_pref(spark, d).select("doc_id", *columns), name, f"SELECT doc_id, {', '.join(columns)} FROM ({ORACLE_SQL['fn_pref']})")


@query(f"{B} SELECT object_id, chunk_id, CASE WHEN chunk_id >= 1 AND chunk_id < 4 THEN 1 ELSE 0 END AS pref FROM chunks")
def obj_migrate_range(spark, d):
    return chunks(spark, d).select("object_id", "chunk_id", F.when((F.col("chunk_id") >= 1) & (F.col("chunk_id") < 4), 1).otherwise(0).alias("pref"))


@query("SELECT DISTINCT source AS name FROM documents WHERE source <> 'src0'")
def src_iter_stores(spark, d):
    """Stores by name; the default store is not listed."""
    return stores(spark, d).filter("name <> 'src0'").select("name")


def stores(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("name")).agg(F.min("doc_id").alias("id"))


@query("SELECT source AS name, min(doc_id) AS id, 2 * min(doc_id) AS data_ds, 2 * min(doc_id) + 1 AS meta_ds FROM documents GROUP BY source")
def join_os_datasets(spark, d):
    s = stores(spark, d)
    datasets = s.select((2 * F.col("id")).alias("ds"), F.col("id").alias("store"), F.lit("data").alias("kind")).unionByName(s.select((2 * F.col("id") + 1).alias("ds"), F.col("id").alias("store"), F.lit("meta").alias("kind")))
    data, meta = (datasets.filter(F.col("kind") == k).select(F.col("store").alias("id"), F.col("ds").alias(f"{k}_ds")) for k in ("data", "meta"))
    return s.join(data, "id").join(meta, "id").select("name", "id", "data_ds", "meta_ds")


@query("SELECT n_name AS name, n_nationkey AS id FROM nation")
def src_iter_datasets(spark, d):
    return datasets(spark, d)


def datasets(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"))


ASKED = "asked AS (SELECT n_name AS name FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'new-' || r_name FROM region)"


def asked(spark, d):
    return table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("name")).union(table(spark, d, "region").select(F.concat(F.lit("new-"), "r_name")))


@query(f"WITH {ASKED} SELECT a.name, n_nationkey AS id, CASE WHEN n_nationkey IS NULL THEN 'does not exist' ELSE 'found' END AS status FROM asked AS a LEFT JOIN nation ON n_name = a.name")
def db_open_dataset(spark, d):
    return K.by_name(datasets(spark, d), asked(spark, d))


named(lambda spark, d: db_open_dataset(spark, d).filter("status = 'found'").select("name", "id"), "join_name_id", f"WITH {ASKED} SELECT a.name, n_nationkey AS id FROM asked AS a JOIN nation ON n_name = a.name")


@query(f"WITH {ASKED} SELECT a.name, CAST(coalesce(n_nationkey, 24 + sum(CASE WHEN n_nationkey IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY CASE WHEN n_nationkey IS NULL THEN 0 ELSE 1 END, a.name)) AS BIGINT) AS id, CASE WHEN n_nationkey IS NULL THEN 'created' ELSE 'already exists' END AS status FROM asked AS a LEFT JOIN nation ON n_name = a.name")
def db_create_dataset(spark, d):
    return K.create_dataset(datasets(spark, d).withColumn("id", F.col("id").cast("long")), asked(spark, d))


SNAPS = "s AS (SELECT o_custkey % 20 AS ds_id, o_orderkey AS gen, 's' || o_orderkey AS name FROM orders)"


def snapshots(spark, d):
    return table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("ds_id"), F.col("o_orderkey").alias("gen"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("name"))


def older_snapshots(spark, d):
    """The snapshots of the older half of generations."""
    rows = snapshots(spark, d)
    return rows.filter(F.col("gen") < (rows.agg(F.max("gen")).first()[0] or 0) // 2)


DEAD = "dead AS (SELECT l_suppkey % 20 AS ds_id, l_orderkey AS died_gen, l_orderkey - l_partkey % 500 AS birth, CAST(l_quantity AS BIGINT) AS size FROM lineitem)"


def deadlist(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("ds_id"), F.col("l_orderkey").alias("died_gen"), (F.col("l_orderkey") - F.col("l_partkey") % 500).alias("birth"), F.col("l_quantity").cast("long").alias("size"))


@query(f"WITH {SNAPS} SELECT gen, name FROM s WHERE ds_id = 3")
def src_iter_snapshots(spark, d):
    return snapshots(spark, d).filter("ds_id = 3").select("gen", "name")


@query(f"WITH {SNAPS} SELECT ds_id, name, gen, lag(gen) OVER w AS prev_gen, lead(gen) OVER w AS next_gen FROM s WINDOW w AS (PARTITION BY ds_id ORDER BY gen)")
def win_next_snapshot(spark, d):
    return K.snapshots_with_neighbours(snapshots(spark, d))


@query(f"WITH {SNAPS}, {DEAD}, n AS (SELECT ds_id, gen, lag(gen) OVER w AS p, lead(gen) OVER w AS x FROM s WINDOW w AS (PARTITION BY ds_id ORDER BY gen)) SELECT n.ds_id, gen, CAST(sum(size) AS BIGINT) AS blocks FROM n JOIN dead AS d ON d.ds_id = n.ds_id AND died_gen > gen AND (x IS NULL OR died_gen <= x) AND (p IS NULL OR birth > p) AND birth > -1 GROUP BY n.ds_id, gen")
def join_snapshot_deadlist(spark, d):
    return K.freed_by_delete(snapshots(spark, d), deadlist(spark, d).filter("birth > -1"))


named(lambda spark, d: join_snapshot_deadlist(spark, d), "snap_delete", ORACLE_SQL["join_snapshot_deadlist"])


@query(f"WITH {SNAPS}, {DEAD}, l AS (SELECT ds_id, max(gen) AS g FROM s WHERE gen < (SELECT max(gen) // 2 FROM s) GROUP BY ds_id) SELECT CASE WHEN coalesce(g, -1) < birth THEN 'removed' ELSE 'preserved' END AS fate, count(*) AS n, CAST(sum(size) AS BIGINT) AS blocks FROM dead AS d LEFT JOIN l ON l.ds_id = d.ds_id GROUP BY 1")
def snap_cow(spark, d):
    fate = K.copy_on_write(deadlist(spark, d), older_snapshots(spark, d))
    return fate.groupBy("fate").agg(F.count("*").alias("n"), F.sum("size").alias("blocks"))


named(lambda spark, d: K.copy_on_write(deadlist(spark, d), older_snapshots(spark, d)).filter("fate = 'removed'").groupBy("ds_id").agg(F.count("*").alias("n")), "flt_ptr_generation", f"WITH {SNAPS}, {DEAD}, l AS (SELECT ds_id, max(gen) AS g FROM s WHERE gen < (SELECT max(gen) // 2 FROM s) GROUP BY ds_id) SELECT d.ds_id, count(*) AS n FROM dead AS d LEFT JOIN l ON l.ds_id = d.ds_id WHERE coalesce(g, -1) < birth GROUP BY d.ds_id")


@query(f"WITH {SNAPS}, new AS (SELECT 's' || o_orderkey AS name, (o_custkey + o_orderkey % 2) % 20 AS ds_id FROM orders) SELECT new.ds_id, new.name, CASE WHEN s.name IS NULL THEN 'created' ELSE 'already exists' END AS status FROM new LEFT JOIN s ON s.ds_id = new.ds_id AND s.name = new.name")
def snap_create(spark, d):
    new = table(spark, d, "orders").select(((F.col("o_custkey") + F.col("o_orderkey") % 2) % 20).alias("ds_id"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("name"))
    old = snapshots(spark, d).select("ds_id", "name", F.lit(True).alias("there"))
    return new.join(old, ["ds_id", "name"], "left").select("ds_id", "name", F.when(F.col("there"), "already exists").otherwise("created").alias("status"))


@query("SELECT s_suppkey % 10 AS device, max(s_suppkey) AS generation, arg_max(s_name, s_suppkey) AS payload FROM supplier WHERE s_acctbal > 0 GROUP BY 1")
def src_superblock(spark, d):
    s = table(spark, d, "supplier")
    slots = s.select((F.col("s_suppkey") % 10).alias("device"), S.superblock_slot(F.col("s_suppkey")).alias("slot"), F.col("s_suppkey").alias("generation"), (F.col("s_acctbal") > 0).alias("valid"), F.col("s_name").alias("payload"))
    return K.newest_superblock(slots)


@query(f"WITH {SNAPS} SELECT 'dataset' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'snapshot', count(*) FROM s UNION ALL SELECT 'store', count(DISTINCT source) FROM documents")
def src_root(spark, d):
    parts = {"dataset": datasets(spark, d), "snapshot": snapshots(spark, d), "store": stores(spark, d)}
    counted = [p.agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k, p in parts.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query(f"{B} SELECT object_id FROM objects WHERE object_id NOT IN (SELECT object_id FROM chunks WHERE chunk_id = 1)")
def join_exists_oid(spark, d):
    return objects(spark, d).select("object_id").join(chunks(spark, d).filter("chunk_id = 1"), "object_id", "left_anti")


@query("SELECT p_partkey, coalesce(min(tier), 254) AS tier FROM part LEFT JOIN (SELECT * FROM (VALUES (0, 1), (1, 2), (2, 1), (3, 5)) AS v(tier, access)) AS t ON t.access = p_size % 7 GROUP BY p_partkey")
def join_tier_access(spark, d):
    """The first tier that prefers the access type asked for."""
    tiers = F.broadcast(spark.createDataFrame([(0, 1), (1, 2), (2, 1), (3, 5)], "tier int, access int"))
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 7).alias("access"))
    return rows.join(tiers, "access", "left").groupBy("p_partkey").agg(F.coalesce(F.min("tier"), F.lit(S.NONE)).alias("tier"))


named(lambda spark, d: join_tier_access(spark, d), "obj_create_access", ORACLE_SQL["join_tier_access"])


# Bytes: two writes over each object, the second over the first's middle or beyond its end, merged into chunks and read back.
BYTES = """
    WITH v AS (
        SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, doc_id % 5 * 100 AS off, doc_id % 7 * 300 + 50 AS w_at, printf('%08X', doc_id) AS y FROM documents
    ), f AS (
        SELECT doc_id, w_at, y, repeat('00', off) || x AS z FROM v
    ), w AS (
        SELECT doc_id, CASE WHEN length(z) < 2 * w_at + 8 THEN left(z || repeat('00', CAST(w_at + 4 AS BIGINT)), 2 * w_at) || y ELSE left(z, 2 * w_at) || y || substr(z, 2 * w_at + 9) END AS z FROM f
    )"""


def byte_writes(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("object_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    first = rows.select("object_id", F.lit(0).cast("long").alias("seq"), (F.col("object_id") % 5 * 100).alias("offset"), F.col("text").alias("data"))
    return first.unionByName(rows.select("object_id", F.lit(1).cast("long").alias("seq"), (F.col("object_id") % 7 * 300 + 50).alias("offset"), by.be_encode(F.col("object_id"), 4).alias("data")))


@query(BYTES + " SELECT doc_id AS object_id, CAST(c AS BIGINT) AS chunk_id, upper(substr(z, CAST(c * 2048 + 1 AS BIGINT), 2048)) AS data FROM (SELECT doc_id, z, unnest(range((length(z) // 2 - 1) // 1024 + 1)) AS c FROM w) WHERE replace(substr(z, CAST(c * 2048 + 1 AS BIGINT), 2048), '00', '') <> ''")
def obj_write_chunks(spark, d):
    """What chunks hold after all writes; chunks that no write touched do not exist."""
    chunks = O.apply_writes(byte_writes(spark, d), 1024)
    # a chunk in the middle is as long as its writes reach: filled up here, as a read does
    last = O.grown_sizes(byte_writes(spark, d))
    full = chunks.join(last, "object_id").select("object_id", "chunk_id", by.zero_extend(F.col("data"), F.least(F.lit(1024), F.col("size") - F.col("chunk_id") * 1024)).alias("data"))
    return full.select("object_id", "chunk_id", F.hex("data").alias("data")).filter(F.replace("data", F.lit("00"), F.lit("")) != "")


@query(BYTES + " SELECT doc_id AS object_id, CAST(greatest(least(900, length(z) // 2 - 700), 0) AS BIGINT) AS n, upper(substr(z, 1401, 1800)) AS data FROM w")
def obj_read_bytes(spark, d):
    """900 bytes from byte 700 of each object, across chunks, zero where nothing was written."""
    return O.read_written(byte_writes(spark, d), 700, 900, 1024).select("object_id", "n", F.hex("data").alias("data"))

from pyspark.sql import functions as F

from tidelog.operators import log as L
from tidelog.operators import policy
from tidelog.streaming import ingest


def test_commits_resolve_as_the_whole_log(spark, tmp_path):
    src, out = f"{tmp_path}/src", f"file://{tmp_path}/log"
    rows = [(bytearray([1 + i % 5]), i, 0, "IUDU"[i % 4], i % 3 if i % 4 in (1, 3) else 0, bytearray(b"" if i % 4 == 2 else bytes([i])), None, None) for i in range(40)]
    for part in (rows[:20], rows[20:]):
        spark.createDataFrame(part, L.LOG_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        messages = spark.readStream.schema(L.LOG_SCHEMA).parquet(src)
        ingest.commit_stream(messages, out, f"{tmp_path}/check").awaitTermination(120)
    log = ingest.read_commits(spark, out)
    as_set = lambda df: {(bytes(r.key), bytes(r.value)) for r in df.collect()}
    whole = as_set(L.resolve(spark.createDataFrame(rows, L.LOG_SCHEMA)))
    assert log.select("gen").distinct().count() == 2 and as_set(L.resolve(log)) == whole
    ingest.compact_commits(spark, out, 1, f"file://{tmp_path}/compact")
    assert as_set(L.resolve(spark.read.parquet(f"file://{tmp_path}/compact"))) == whole


def test_frequencies(spark, tmp_path):
    spark.range(30).select((F.col("id") % 4).alias("object_id"), (F.col("id") % 3).cast("int").alias("tier"), F.col("id").alias("seq")).write.parquet(f"{tmp_path}/a")
    stream = spark.readStream.schema("object_id long, tier int, seq long").parquet(f"{tmp_path}/a")
    query = ingest.frequency_stream(stream).writeStream.format("memory").queryName("freq").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.object_id: (r.freq, r.last_tier) for r in spark.table("freq").collect()} == {0: (8, 1), 1: (8, 2), 2: (7, 2), 3: (7, 0)}


def test_a_policy_moves_objects_by_batches(spark, tmp_path):
    """Hot objects of the lower tier go up, cold ones of the full upper tier go down, in the turn of their batch."""
    rows = [(o, 1, i, 10) for i, o in enumerate([1] * 9 + [2] * 5 + [3])] + [(o, 0, 100 + i, 10) for i, o in enumerate([7] * 6 + [8] * 2)]
    spark.createDataFrame(rows, "object_id long, tier int, seq long, size long").write.parquet(f"{tmp_path}/a")
    tiers = spark.createDataFrame([(0, 5, 1000), (1, 900, 1000)], "tier int, free long, total long")
    stream = spark.readStream.schema("object_id long, tier int, seq long, size long").parquet(f"{tmp_path}/a")
    ingest.policy_stream(stream, policy.LeastFrequentlyUsed(promote_blocks=15), tiers, f"file://{tmp_path}/moves", f"{tmp_path}/check", 0.98).awaitTermination(120)
    moves = {(r.object_id, r.tier, r.target) for r in spark.read.parquet(f"file://{tmp_path}/moves").collect()}
    assert moves == {(1, 1, 0), (2, 1, 0), (7, 0, 1), (8, 0, 1)}


def test_updates_by_batches_leave_the_newest(spark, tmp_path):
    for part in (range(10), range(10, 30)):
        spark.createDataFrame([(i % 4, i % 3, i) for i in part], "object_id long, tier int, seq long").write.mode("append").parquet(f"{tmp_path}/a")
        stream = spark.readStream.schema("object_id long, tier int, seq long").parquet(f"{tmp_path}/a")
        ingest.keep_latest(ingest.frequency_stream(stream), f"file://{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    found = ingest.read_latest(spark, f"file://{tmp_path}/out", "object_id").collect()
    assert {r.object_id: (r.freq, r.last_tier) for r in found} == {0: (8, 1), 1: (8, 2), 2: (7, 2), 3: (7, 0)}

"""Text sources and sinks with fixed schemas: metrics and policy state as JSON lines, measurements as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPACE = "array<struct<free:bigint,total:bigint>>"
METRICS = f"epoch_ms bigint, cache struct<capacity:bigint,size:bigint,len:bigint,hits:bigint,misses:bigint,insertions:bigint,evictions:bigint,removals:bigint>, storage struct<tiers:array<struct<vdevs:array<struct<read:bigint,written:bigint,failed_reads:bigint,failed_writes:bigint,checksum_errors:bigint>>>>>, usage {SPACE}"
MEASUREMENTS = {
    "evaluation": "offset bigint, size bigint, latency_ns bigint, op string",
    "filesystem": "key string, size bigint, read_latency_ns bigint, write_latency_ns bigint, `group` int",
    "checkpoints": "generation bigint, size_mib bigint, object_num bigint, time_ms bigint",
    "ycsb": "threads int, ops bigint, time_ns bigint",
    "policy_delta": "object string, size bigint, time bigint, from_tier int, to_tier int",
}


def read_jsonl(spark: SparkSession, path: str, schema: str = METRICS) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Measurements of one of the kinds in MEASUREMENTS, with a header line."""
    return spark.read.schema(MEASUREMENTS[kind]).csv(path, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)

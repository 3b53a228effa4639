"""What the operators share: the shared folder, written intermediates, joins with few ids."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts name.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of narrow tables (ids, hashes) that may be broadcast: some 8 MB as a hash table. They are counted first.
BROADCAST_ROWS = 200_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the cluster's spark.checkpoint.dir.

    Only a session in one process, as in tests, may do without: one is made for it.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidelog.scratch.dir", None)
    if not known:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("tidelog.scratch.dir", known)
    return f"{known.rstrip('/')}/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Writes df under path and reads it back; the shuffles that made it are dropped as soon as it is written."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back.

    Cuts the lineage: a lost executor costs the tasks of one step, not the whole plan. The table stays until `release`.
    """
    return write_table(df, scratch(df.sparkSession, name))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Deletes all tables that this application has written to the shared folder; results that read them end."""
    _delete(spark, shared_dir(spark))


class Workspace:
    """Written intermediates that an operator drops after their last reader."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, scratch(spark, name)
        self._tables: dict[int, tuple[DataFrame, str]] = {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        found = write_table(df, path)
        self._tables[id(found)] = found, path
        return found

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing will read again."""
        for t in tables:
            _delete(self.spark, self._tables.pop(id(t))[1])


def few(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written narrow table, to be broadcast if it has at most so many rows; larger ones are shuffled."""
    return F.broadcast(table) if table.count() <= rows else table


_remembered: dict[str, Callable[[], None]] = {}
_working_on: list[str] = []


def remembers(name: str, forget: Callable[[], None]) -> None:
    """Says how a worker forgets what an operator remembers from task to task."""
    _remembered[name] = forget


def works_on(name: str) -> None:
    """Called at the start of a task: the worker forgets what other operators have left, and gives that memory back.

    A worker lives through all stages, and what Arrow and the C library keep of freed memory counts in each of them.
    """
    if _working_on == [name]:
        return
    for other, forget in _remembered.items():
        if other != name:
            forget()
    _working_on[:] = [name]
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def text_or_empty(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken = {c.lower() for c in df.columns}
    result = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        result.append(name)
    return result

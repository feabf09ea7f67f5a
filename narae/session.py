"""Scratch tables in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir`` as the session has it. Where that setting is absent, a session on a
cluster uses a folder below its warehouse, which is shared as well; a local session uses one of its own.
The session's settings stay as they are.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
#: Removes an execution's shuffle files at its end; set only while a table is written.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if spark.sparkContext.master.startswith("local"):
        own = tempfile.mkdtemp(prefix="narae-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        return own
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/narae-scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = f"{_base(spark).rstrip('/')}/narae-{app}"
        _drop_at_exit(spark, _ROOTS[app])
    return f"{_ROOTS[app]}/{name}-{uuid.uuid4().hex[:12]}"


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver ends, whether or not the session was stopped before."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(jsc.hadoopConfiguration())
    files.mkdirs(target)
    files.deleteOnExit(target)  # by the driver's JVM, on any file system
    local = path.removeprefix("file://").removeprefix("file:")
    if os.path.isdir(local):
        atexit.register(shutil.rmtree, local, ignore_errors=True)


def materialise(df: DataFrame, name: str, codec: str = "zstd", *folders: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder, with folders by these columns, and read it from there.

    Cuts the lineage: lost executors only cost a re-read, never a recomputation of what came before.
    The write's own shuffle files go with it, as nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", codec).partitionBy(*folders).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialise`` wrote and nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(table.scratch)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


#: Bytes of a table for each core up to which it is dealt to all cores.
SMALL = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table too small to have a partition for each core, dealt to all of them; any other as it is.

    A file of one row group is read by one task, whatever comes after. Only some megabytes are moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return df.repartition(cores) if size <= SMALL * cores else df


# --- memory of Python workers ----------------------------------------------------------------


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers some megabytes at a time, unless the session has its own setting.

    Spark's default of 64 MB a batch is held several times over: by the JVM outside its heap, by the
    worker, and as the rows made of it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "67108864", "64MB", "64m"):
        spark.conf.set(name, "8m")


def release() -> None:
    """Gives freed memory back to the system: workers outlive their tasks, and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(rows: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over Arrow batches that ends with release()."""

    def run(batches: Iterator) -> Iterator:
        yield from rows(batches)
        release()

    return run


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of an Arrow batch as Python values, one at a time."""
    for row in zip(*batch.columns):
        yield tuple(value.as_py() for value in row)

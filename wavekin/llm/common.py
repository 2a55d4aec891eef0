"""Shared plumbing: staged tables in the cluster's shared folder, small expression helpers."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED = "spark.checkpoint.dir"
#: Used only in local mode where the session names no shared folder, as in tests.
LOCAL_SHARED = "/tmp/checkpoints/wavekin"

_ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: the session's ``spark.checkpoint.dir``, else one in the warehouse; in local mode a local one."""
    named = spark.conf.get(SHARED, None) or spark.sparkContext.getConf().get(SHARED)
    if named:
        return named
    return LOCAL_SHARED if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back.

    The copy cuts lineage and survives the loss of any executor. Inside ``passing`` it is deleted at the end.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    trim_native(df.sparkSession)
    if (own := _PASSING.get()) is not None:
        own.append(path)
    return out


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables staged inside, at the end, but for those handed to the function that this gives.

    Nothing that is used later may read the deleted ones, so results are to be staged inside as well.
    """
    outer, own, kept = _PASSING.get(), [], set()
    token = _PASSING.set(own)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.staged_path)
        return df

    try:
        yield keep
    finally:
        _PASSING.reset(token)
        for path in own:
            if path not in kept:
                remove(spark, path)
            elif outer is not None:
                outer.append(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Rows of a batch between Spark and Python, at most. Documents are kilobytes each, so the default of 10,000 would hold tens of megabytes several times over.
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's batch size for text rows."""
    if not 0 < int(spark.conf.get(_BATCH_CONF)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))


#: Bytes of text that a task works on at a time, about.
PART_BYTES = 2 << 20


def text_parts(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about PART_BYTES of text each; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes) - sizes) // PART_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for lo, hi in zip(edges, edges[1:], strict=False):
        if lo < hi:
            yield batch.slice(lo, hi - lo)


def release() -> None:
    """Give memory that a finished task no longer uses back to the system; Python workers live on for other tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trim_native(spark: SparkSession) -> str | None:
    """Have the driver's JVM give freed native memory back to the system; its answer, or None from a JVM that has no such command.

    Every exchange of every plan gets a thread of its own, and these, the compilers and the class loaders take memory from many
    arenas of the C library, which keep it: hundreds of megabytes beside the heap after some hundred plans.
    """
    gateway = spark.sparkContext._gateway
    java = gateway.jvm.java.lang
    with suppress(Py4JError):
        # by its interface, as Python cannot reach into the server's own class
        invoke = next(m for m in java.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        command = gateway.new_array(java.Object, 4)
        command[0], command[1] = gateway.jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return invoke.invoke(java.management.ManagementFactory.getPlatformMBeanServer(), command)
    return None


def tidy(spark: SparkSession) -> None:
    """Give back what finished plans still hold on the driver.

    Python lets go of its plans first, so that the JVM can drop theirs with their
    classes and broadcasts. For drivers that run many plans one after another.
    """
    gc.collect()
    release()
    spark.sparkContext._jvm.System.gc()
    trim_native(spark)


#: Keys beyond which a key with the mean number of rows counts as hot, and rows that make a key hot at least.
HOT_KEYS, HOT_ROWS = 200_000, 1000


def join_counted(rows: DataFrame, values: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined with ``values``, which has one row a key and in ``count`` how many of the ``total`` rows have it.

    Where keys can be hot, the values are staged first: small ones are then broadcast, and of larger ones both sides are
    plain shuffles, of which Spark splits the partitions that a hot key makes large. The result is to be
    staged or shuffled by another key, as Spark does not split what has to stay together by ``key``.
    """
    if total > max(HOT_ROWS, total // HOT_KEYS):
        values = stage(values, "values")
    return rows.join(values, key)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only, as the contracts ask."""
    return F.translate(col, _ASCII_UPPER, _ASCII_UPPER.lower())


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def literal(text: str) -> str:
    """A Python string as the inside of a Spark SQL string literal."""
    return text.replace("\\", "\\\\").replace("'", "\\'")

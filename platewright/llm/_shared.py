"""Tables that cut lineage, written to the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes that are broadcast.
BROADCAST_BYTES = 32 << 20
_thread = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a local folder only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.gettempdir() + "/spark-shared"
    return found.rstrip("/")


def live() -> list[str]:
    """Paths of this thread's `written` tables that nobody has removed yet."""
    if not hasattr(_thread, "live"):
        _thread.live = []
    return _thread.live


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`df` written as Parquet and read again, and its path."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    live().append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of `written` that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in live():
        live().remove(path)


def swept(spark: SparkSession, start: int, keep: str) -> None:
    """Remove what `written` made since `live` had `start` tables, but for `keep`."""
    for path in live()[start:]:
        if path != keep:
            removed(spark, path)


def small(rows: DataFrame) -> DataFrame:
    """`rows` marked for broadcast if they have at most BROADCAST_BYTES; larger ones meet the others in a shuffle.

    A row of numbers, flags and digests takes 24 bytes and 24 for each column at most.
    """
    return F.broadcast(rows) if rows.count() * (24 + 24 * len(rows.columns)) <= BROADCAST_BYTES else rows


def freed(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of data frames that nothing holds any more."""
    gc.collect()
    spark._jvm.System.gc()


def lean(apply: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`apply` of mapInArrow whose worker gives its task's memory back at the end: workers stay and wait for later stages."""

    @functools.wraps(apply)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from apply(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
        if trim:
            trim(0)

    return run

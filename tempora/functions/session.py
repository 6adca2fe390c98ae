"""Where a job keeps its intermediate tables, and how they are cut from their lineage.

Intermediate tables are Parquet files below the folder that the cluster names in
``spark.checkpoint.dir``: every executor and the driver can read them, and they outlive any
executor.  Only where that setting is absent on a single machine (tests) a folder is made here; on
a cluster its absence is an error.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def scratch(spark: SparkSession) -> str:
    """The shared folder of this session, as a URI without a trailing slash."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        base = "file://" + tempfile.mkdtemp(prefix="tempora-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut(df: DataFrame, tag: str = "cut") -> DataFrame:
    """Write ``df`` once and return the written table: no lineage, exact size statistics."""
    spark = df.sparkSession
    path = fresh(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tempora_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by :func:`cut` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_tempora_path", None)
        if path:
            spark = df.sparkSession
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def trimmed() -> None:
    """Give back what Arrow's pool and the C library hold unused."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of ``mapInArrow``, before which the worker drops the tokenizer and its table of words, if another
    operator left them, and after which it gives back what is held unused: workers are kept for later
    tasks, and an executor pays for all that wait."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = sys.modules.get("tempora.llm.encoder")
        if kept is not None and kept.encoder.cache_info().currsize:
            kept.encoder.cache_clear()
            gc.collect()  # an encoder and its words refer to each other
            trimmed()
        yield from run(batches)
        trimmed()

    return whole


def partitions(spark: SparkSession) -> int:
    """How many partitions a keyed exchange is dealt to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table_bytes(df: DataFrame) -> int:
    """Size of a table made by :func:`cut`, from its files."""
    path = getattr(df, "_tempora_path", None)
    if path is None:
        raise ValueError("only tables made by cut() have a known size")
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(hadoop).getLength())

"""Helpers that every operator of this subpackage uses."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    A session without that setting gets a temporary folder if it runs in one process, as in tests; on a cluster it is an
    error, since executors would not see a local folder of the driver.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    path = f"{checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    """Removes a working table when the driver ends; a session that is gone needs nothing."""
    jsc = getattr(spark.sparkContext, "_jsc", None)
    if jsc is None:
        return
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may have ended first
        return


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` to the shared folder and reads it back."""
    path = shared_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_side(keys: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A narrow key table, broadcast only if it is counted to have ``most`` rows or fewer; else joins shuffle it."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def bound_batches(spark: SparkSession) -> None:
    """Bounds what goes to a Python worker at once by bytes, so that rows with long texts do not add up to a large batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, so extra columns with clashing names never matter; a null text is an empty one."""
    bound_batches(docs.sparkSession)
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in ("text", "html") else F.col(c) for c in columns])


def release() -> None:
    """Gives memory that a worker has freed back to the system, since workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def trimmed(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task``, giving back what it has freed when it ends: an idle worker would hold it while others need the memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            release()

    return run


def grouped(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Re-cuts batches so that one piece holds about ``limit`` bytes of ``column`` (one long value may exceed it)."""
    release()
    for batch in batches:
        values = batch.column(column)
        if batch.num_rows == 0:
            continue
        wide = values.cast(pa.large_binary()) if not pa.types.is_large_binary(values.type) else values
        ends = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
            stop = max(start + 1, min(stop, batch.num_rows))
            yield batch.slice(start, stop - start)
            start = stop


def binary16(values: np.ndarray) -> pa.Array:
    """Names of 16 bytes as an Arrow array of binary."""
    data = np.ascontiguousarray(values)
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(data), [None, pa.py_buffer(data.tobytes())])
    return fixed.cast(pa.binary())


def rows(schema: pa.Schema, columns: Sequence[Iterable]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

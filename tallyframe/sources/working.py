"""Working tables: results that a plan reads more than once, written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def working_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a session in one process may go without and gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def working(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once and read back; the table goes when the driver ends."""
    path = f"{working_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_drop, df.sparkSession, path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if getattr(context, "_jsc", None) is None:
        return
    try:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may have ended first
        return

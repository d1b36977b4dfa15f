"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """A new folder in the cluster's spark.checkpoint.dir, or a temporary one in a local session without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-work-")
    return f"{root.rstrip('/')}/work-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df written once and read back: for a table that a plan reads more than once."""
    folder = work_folder(df.sparkSession)
    df.write.parquet(folder)
    atexit.register(_remove, df.sparkSession, folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, system = _at(spark, path)
    return system.exists(at)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at, system = _at(spark, path)
        system.delete(at, True)
    except Exception:  # noqa: BLE001  the JVM may have gone before this process ends
        return

"""Helpers that every operator of the subpackage uses: table access, staging, folds."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes of its staged Parquet files, that is sent to every task.
BROADCAST_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stage_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="tessera-stage-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage, survives lost executors, and gives the planner the true size of the table.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the JVM may have gone before this process ends
        return


def stored_bytes(df: DataFrame) -> int:
    """Size of a staged table as the planner sees it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its staged size is within BROADCAST_BYTES, else df for a shuffled join."""
    return F.broadcast(df) if stored_bytes(df) <= BROADCAST_BYTES else df


def packed(df: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    """df as the columns needed (those it has) and one struct of all others, so that no name of theirs is in the way."""
    others = [c for c in df.columns if c not in needed]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(0)
    return df.select(*[c for c in needed if c in df.columns], rest.alias("__rest"))


def unpacked(df: DataFrame, columns: list[str], needed: tuple[str, ...], mine: tuple[str, ...] = ()) -> DataFrame:
    """The caller's columns of packed(..., needed), in their order, then mine, which replace columns of these names."""
    own = [F.col(c) if c in needed else F.col("__rest").getField(c).alias(c) for c in columns if c not in mine]
    return df.select(*own, *mine)


def held_out(doc_id: str = "doc_id"):
    """True for the documents that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def tune(spark: SparkSession, rows: int = 128) -> None:
    """Keep Arrow batches of whole texts small, as a worker holds one at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))

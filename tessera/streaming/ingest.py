"""Structured Streaming extensions: watermarked windows of events, and incremental indexing of arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.staging import work_folder

EVENT = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours", kind: str = "event_type") -> DataFrame:
    """(window_start, kind, n, total) of tumbling windows; works on streams and tables."""
    timed = events.withColumn("__ts", F.col("ts").cast("timestamp")).withWatermark("__ts", late)
    grouped = timed.groupBy(F.window("__ts", width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), kind, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, session_start, session_end, n) of users' sessions; works on streams and tables."""
    timed = events.withColumn("__ts", F.col("ts").cast("timestamp")).withWatermark("__ts", late)
    grouped = timed.groupBy("user_id", F.session_window("__ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    return spark.readStream.schema(EVENT).option("pathGlobFilter", pattern).parquet(folder)


def drained(stream: DataFrame) -> DataFrame:
    """Run a stream over what is there now and return what it appended: windows that the watermark has closed."""
    folder, schema = work_folder(stream.sparkSession), stream.schema
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(f"{folder}/out")


def index_arrivals(stream: DataFrame, build, state: str):
    """Index each micro-batch of files (path, content). A stream never reports vanished files: run the batch diff for those.

    build(batch) is called once for a batch; it has to be idempotent, as a batch may be repeated after a failure.
    """
    return stream.writeStream.foreachBatch(lambda batch, _: build(batch)).option("checkpointLocation", state).trigger(availableNow=True).start()

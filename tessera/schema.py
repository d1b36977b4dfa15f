"""Schemas of the stored tables, and the strict check before a write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

BLOCKS = T.ArrayType(T.StructType([
    T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("title", T.StringType()),
    T.StructField("kind", T.StringType()), T.StructField("symbols", T.ArrayType(T.StringType())),
]))

FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("length", T.LongType())])

MANIFEST = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("hash", T.StringType()),
    T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType()),
])

REPORT = T.StructType([T.StructField("path", T.StringType()), T.StructField("seconds", T.DoubleType()), T.StructField("error", T.StringType())])

CHUNK = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("path", T.StringType()), T.StructField("hash", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("chunk_id", T.IntegerType()), T.StructField("chunks", T.IntegerType()),
    T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()),
    T.StructField("file_size", T.LongType()), T.StructField("size", T.LongType()), T.StructField("file_lines", T.IntegerType()),
    T.StructField("extension", T.StringType()), T.StructField("filename", T.StringType()), T.StructField("mime", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType()),
    T.StructField("llm_version", T.StringType()), T.StructField("title", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("symbols", T.ArrayType(T.StringType())),
])


def strict(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df in the order of schema; fails on a missing or unknown column or another type."""
    have, want = {f.name: f.dataType.simpleString() for f in df.schema}, {f.name: f.dataType.simpleString() for f in schema}
    if have != want:
        wrong = sorted(k for k in have.keys() | want.keys() if have.get(k) != want.get(k))
        raise ValueError(f"columns differ from the schema: {', '.join(wrong)}")
    return df.select(*[f.name for f in schema])

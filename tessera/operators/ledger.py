"""Token ledger and conversation pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.staging import exists

#: Cost of a written and a read cache token, in input tokens; rounds of tools and pages that are looked at.
WRITE, READ, ROUNDS, PAGES = 1.25, 0.1, 12, 3
COUNTERS = ("input", "cache_write", "cache_read", "output")


def totals(calls: DataFrame, *by: str) -> DataFrame:
    """Sums of the four counters; null counts as 0."""
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c) for c in COUNTERS]
    return calls.groupBy(*by).agg(*sums) if by else calls.agg(*sums)


def cost(summed: DataFrame) -> DataFrame:
    """paid, total and saved equivalents of totals(); saved may be negative."""
    paid = F.col("input") + WRITE * F.col("cache_write") + READ * F.col("cache_read")
    used = F.col("input") + F.col("cache_write") + F.col("cache_read")
    return summed.withColumns({"paid": paid, "total": paid + F.col("output"), "saved": used - paid})


def within_rounds(calls: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    return calls.where(F.col("round") <= rounds)


def pages(messages: DataFrame) -> DataFrame:
    """(conv_id, page_no, text): one page for each turn of a user and what follows, as canonical JSON.

    messages: conv_id, turn, role, text. Blank texts and other roles than user and assistant are left out.
    """
    spoken = messages.where(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    order = Window.partitionBy("conv_id").orderBy("turn")
    numbered = spoken.withColumn("page_no", F.sum((F.col("role") == "user").cast("int")).over(order))
    # keys of each message in order of the alphabet
    entry = F.struct("turn", F.struct("role", F.trim("text").alias("text")).alias("m"))
    grouped = numbered.groupBy("conv_id", "page_no").agg(F.array_sort(F.collect_list(entry)).alias("__m"))
    return grouped.select("conv_id", F.col("page_no").cast("int").alias("page_no"), F.to_json(F.transform("__m", lambda x: x["m"])).alias("text"))


def last_pages(pages_: DataFrame, n: int = PAGES) -> DataFrame:
    """One row for a conversation: page1 (newest) to pageN and their lengths, empty if there are fewer."""
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("page_no")))
    recent = pages_.withColumn("__r", newest).where(F.col("__r") <= n)
    text = lambda k: F.coalesce(F.max(F.when(F.col("__r") == k, F.col("text"))), F.lit(""))
    wide = recent.groupBy("conv_id").agg(*[text(k).alias(f"page{k}") for k in range(1, n + 1)])
    return wide.withColumns({f"chars{k}": F.length(f"page{k}").cast("long") for k in range(1, n + 1)})


def append_pages(spark: SparkSession, path: str, messages: DataFrame) -> None:
    """Append the pages of messages (see pages()) to the table at path; numbers go on after each conversation's last page."""
    fresh = pages(messages)
    schema = "conv_id long, page_no int, text string"
    known = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    last = known.groupBy(F.col("conv_id").alias("__c")).agg(F.max("page_no").alias("__last"))
    numbered = fresh.withColumn("__n", F.row_number().over(Window.partitionBy("conv_id").orderBy("page_no")))
    placed = numbered.join(last, F.col("conv_id") == F.col("__c"), "left").select("conv_id", (F.coalesce("__last", F.lit(0)) + F.col("__n")).cast("int").alias("page_no"), "text")
    placed.write.mode("append").parquet(path)

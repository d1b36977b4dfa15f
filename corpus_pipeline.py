"""A corpus pipeline of five stages over documents: toxicity, near duplicates, benchmark leaks, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents, with the caller's values whatever their names;
the last one adds size, shard and slot, which replace columns of these names. Stages decide on rows, not on ids: rows
with a null or a repeated id are judged by their own text. Null and empty texts are kept by the filtering stages, texts of
any length are read whole, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.op02_sharding import shard_documents
from tessera.llm.op05_toxicity import learned, score
from tessera.llm.op06_mixing import mix
from tessera.llm.op07_jaccard_join import jaccard_join
from tessera.llm.op08_decontamination import contaminated
from tessera.llm.shared import packed, read, small, stage, tune, unpacked

_NEEDED = ("doc_id", "text", "source")


def _numbered(docs: DataFrame) -> DataFrame:
    """__row (of its own for each row), and docs as packed() has them; written, so that the numbers stay."""
    return stage(packed(docs, _NEEDED).select(F.monotonically_increasing_id().alias("__row"), "*"), "numbered")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model does not reject."""
    tune(spark)
    scored = score(packed(docs, _NEEDED), learned(spark, docs, sf_dir))
    return unpacked(scored.where("predicted = 0"), docs.columns, _NEEDED)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id; of rows alike in it, that with the least text hash.

    A row whose text has no word is a group of its own.
    """
    tune(spark)
    rows = _numbered(docs)
    classes = stage(jaccard_join(rows.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "class_id"), "classes")
    many = stage(classes.groupBy("class_id").count().where("count > 1").select("class_id"), "copied")
    members = classes.join(small(many), "class_id", "left_semi").join(rows.select("__row", "doc_id", F.xxhash64("text").alias("__hash")), "__row")
    # a null id comes last
    first = members.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__hash", "__row"))["__row"].alias("__row"))
    dropped = stage(members.select("__row").join(first.select("__row"), "__row", "left_anti"), "near-copies")
    return unpacked(rows.join(small(dropped), "__row", "left_anti"), docs.columns, _NEEDED)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    rows = _numbered(docs)
    found = contaminated(rows.select(F.col("__row").alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    leaks = stage(found.select(F.col("doc_id").alias("__row")).distinct(), "leaks")
    return unpacked(rows.join(small(leaks), "__row", "left_anti"), docs.columns, _NEEDED)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mix(packed(docs, _NEEDED)).where("times > 0")
    repeated = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return unpacked(repeated, docs.columns, _NEEDED)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed rows with size, shard and slot."""
    return shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Models, signatures and the knapsack have no SQL form; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

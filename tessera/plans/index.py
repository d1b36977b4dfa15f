"""Entry points that keep the stores: masking a tree, and the incremental index."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import blocks, masking, paths
from tessera.functions.text import cleaned
from tessera.operators import sync
from tessera.operators.vectors import embed_with, hashed_embedding
from tessera.sources import files
from tessera.sources.staging import staged
from tessera.sources.store import Store

EMPTY = "empty file"


def mask_files(scanned: DataFrame, ignore: str = "", mode: str = "strict", extractors=None) -> tuple[DataFrame, DataFrame]:
    """(safe files, errors): path, text; and path, error. scanned: path, content.

    Text files are masked as they are; others go through an extractor by suffix and are cleaned first. Ignored paths
    are left out, a failing file is an error row and nothing else.
    """
    kept = scanned.withColumn("path", paths.normalise("path")).where(~files.ignored("path", files.ignore_rules(ignore)))
    plain = kept.withColumn("__text", files.strict_text("content"))
    pulled = plain.withColumn("__x", F.when(F.col("__text").isNull(), files.extracted(extractors)(paths.suffix("path"), F.when(F.col("__text").isNull(), F.col("content")))))
    text = F.coalesce("__text", cleaned("__x.text"))
    done = pulled.select("path", masking.masked(text, mode).alias("text"), F.col("__x.error").alias("error"))
    return done.where("text is not null").select("path", "text"), done.where("text is null").select("path", F.coalesce("error", F.lit("no text")).alias("error"))


def mask_tree(spark: SparkSession, source: str, target: str, ignore: str = "", mode: str = "strict") -> DataFrame:
    """Mask all files below source and replace the safe table at target; returns the errors."""
    safe, errors = mask_files(files.scan(spark, source), ignore, mode)
    safe.write.mode("overwrite").parquet(target)
    return errors


def build_chunks(changed: DataFrame, splitter=blocks.structural, model=hashed_embedding, version: str = "structural-1", now: dt.datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, report) of files (path, hash, content): split, normalised, embedded; and path, seconds, error of each file.

    Both are read from one staged table, so that a file is split once. A file that cannot be split has no chunks.
    """
    stamp = F.lit(now or dt.datetime.now(dt.timezone.utc)).cast("timestamp")  # one value for all that is built
    texts = changed.withColumn("text", files.lenient("content"))
    filled = F.when(F.col("text") != "", F.col("text"))
    split = texts.withColumn("__s", blocks.split_apart(splitter)(filled))
    error = F.when(filled.isNull(), F.lit(EMPTY)).otherwise(F.col("__s.error"))
    done = staged(split.select("path", "hash", F.octet_length("content").cast("long").alias("file_size"), "text", F.col("__s.blocks").alias("blocks"), F.col("__s.seconds").alias("seconds"), error.alias("error")))
    good = done.where("error is null")
    parts = blocks.chunks(good.select("path", "text", "blocks")).join(good.select("path", "hash", "file_size"), "path")
    full = parts.withColumns({
        "embedding": embed_with(model)("text"), "extension": paths.extension("path"), "filename": paths.filename("path"),
        "mime": paths.mime("path"), "lang": paths.language("path"), "created_at": stamp, "updated_at": stamp, "llm_version": F.lit(version),
    })
    return full, done.select("path", "seconds", "error")


def unindexable(scanned: DataFrame) -> DataFrame:
    """path, error: files that build() leaves out, as they have no text."""
    return scanned.where(F.coalesce(files.lenient("content"), F.lit("")) == "").select(paths.normalise("path").alias("path"), F.lit(EMPTY).alias("error"))


def build(spark: SparkSession, scanned: DataFrame, store: Store, ignore: str = "", keep_created: bool = False, **how) -> dict[str, int]:
    """Bring the store up to date with scanned (path, content); returns how many paths had each action.

    Only new and changed files are read further. Files that are empty or fail are not indexed, and tried again by the next
    build; store.report() has the reasons, and the seconds of every file. Nothing is written if nothing changed.
    """
    rules = files.ignore_rules(ignore)
    named = scanned.withColumn("path", paths.normalise("path"))
    current = named.select("path", F.when(~files.ignored("path", rules), paths.blob_oid("content")).alias("hash"))
    before = store.manifest()
    actions = staged(sync.diff(current, before).where("action != 'none'"))
    counts = {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()}
    if not any(counts.get(a) for a in ("delete", "index", "reindex")):
        return counts
    built, report = build_chunks(named.join(sync.to_index(actions), "path"), **how)
    fresh = staged(built.select(*store.chunks().columns))
    stamps = fresh.groupBy("path").agg(F.first("hash").alias("hash"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))
    if keep_created:
        old = before.select("path", F.col("created_at").alias("__c"))
        stamps = stamps.join(old, "path", "left").withColumn("created_at", F.coalesce("__c", "created_at")).drop("__c")
    store.commit(sync.replaced(store.chunks(), actions, fresh), sync.replaced(before, actions, stamps.select(*before.columns)), report)
    return counts


def export_files(safe: DataFrame, target: str) -> None:
    """Write each text of safe (path, text) as a UTF-8 file at the same relative path below target.

    Tasks write the files themselves: target is a folder that all executors share.
    """
    from pathlib import Path

    def write(rows) -> None:
        for row in rows:
            at = Path(target) / row["path"]
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(row["text"], encoding="utf-8", newline="\n")

    safe.select("path", "text").where("text is not null and path != '' and not path rlike '(^|/)[.][.](/|$)'").foreachPartition(write)

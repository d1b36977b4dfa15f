"""Incremental synchronisation: snapshot diff by content hash, and its application to the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIONS = ("none", "delete", "index", "skip", "reindex")


def diff(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, current_hash, stored_hash, action) of every path of either side.

    current: path, hash (null for an ignored file); stored: path, hash. One full outer join.
    """
    now = current.select("path", F.col("hash").alias("current_hash"))
    before = stored.select("path", F.col("hash").alias("stored_hash"))
    cur, old = F.col("current_hash"), F.col("stored_hash")
    action = F.when(cur.isNull() & old.isNull(), "none").when(cur.isNull(), "delete").when(old.isNull(), "index").when(cur == old, "skip").otherwise("reindex")
    return now.join(before, "path", "full_outer").select("path", "current_hash", "stored_hash", action.alias("action"))


def pending(actions: DataFrame) -> DataFrame:
    """What has to be done: empty on a second run over an unchanged corpus."""
    return actions.where(F.col("action").isin("delete", "index", "reindex"))


def to_index(actions: DataFrame) -> DataFrame:
    return actions.where(F.col("action").isin("index", "reindex")).select("path", F.col("current_hash").alias("hash"))


def replaced(stored: DataFrame, actions: DataFrame, added: DataFrame) -> DataFrame:
    """stored without the rows of deleted and changed paths, and with the added ones."""
    gone = actions.where(F.col("action").isin("delete", "reindex")).select("path")
    return stored.join(gone, "path", "left_anti").unionByName(added)

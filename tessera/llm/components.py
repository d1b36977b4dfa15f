"""Connected components of links in a table: by alternating large and small stars, and by one task if they are few."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import BROADCAST_BYTES, small, stage, stored_bytes

#: Links that one task joins, at most.
FEW = 200_000


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """One star round over edges (u, v), u > v: neighbours are linked to the least neighbour instead.

    few: the edges are known to be so few that a row for each node may be sent to every task. Else these rows are staged,
    for a join by shuffle in which the rows of a hub can be split.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    linked = both.join(F.broadcast(least) if few else small(stage(least, "least")), "u")
    if large:
        return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component of all links (u, v), u > v."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for b in batches:
        for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True):
            low, high = sorted((root(u), root(v)))
            parent[high] = low
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "component"])


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node, component (its least node), for every node of edges (a long, b long). Self links are ignored.

    Up to FEW different links are joined by one task, in which they need no rounds. Of more, each round is written to the
    shared folder; the number of rounds grows with the logarithm of the longest path.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stage(edges, "links")
    if stored_bytes(edges) <= BROADCAST_BYTES and edges.count() <= FEW:
        return stage(edges.coalesce(1).mapInArrow(_joined, "node long, component long"), "components")
    before = None
    for _ in range(rounds):
        few = stored_bytes(edges) <= BROADCAST_BYTES // 2
        edges = stage(_star(_star(edges, True, few), False, few), "stars")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return stage(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct(), "components")

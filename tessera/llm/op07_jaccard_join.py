"""N-gram Jaccard join by a MinHash LSH forest, verified exactly.

1. Every text becomes its set of five-word shingles. Texts with equal sets form a class.
2. A class has a MinHash signature of TREES labels of DEPTH values, each a path in one prefix trie. A trie is kept as the
   table of its nodes: a node is a prefix of FLOOR values or more and knows how many classes are below it. A class begins
   with its whole labels and shortens them one value at a time, in the trie where that adds the fewest classes, until a
   pair at the threshold shares one of its prefixes with probability RECALL. All classes below a node that some class
   has come to are candidates of each other; linked candidates form a group.
3. A group is compared exactly, from the sets themselves: classes whose sizes can be similar, block by block, so that no
   task holds a group and no pair is written. A task returns the number of links of each of its classes and a spanning
   forest of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shared import read, small, stage, tune
from tessera.llm.shingles import binaries, shingle_sets
from tessera.llm.textarrays import chunks

THRESHOLD, RECALL = 0.8, 0.999
#: Tries; values of a label and bytes of a value; the shortest prefix.
TREES, DEPTH, WIDTH, FLOOR = 24, 8, 2, 5
#: Classes in a block of a large group; shingles that are compared at once.
BLOCK, COLUMNS = 1024, 4096
#: Bytes of sets in a block, about: a group of long texts gets smaller blocks.
BLOCK_BYTES = 24 << 20


def floor_for(threshold: float, recall: float, trees: int = TREES) -> int:
    """FLOOR, or the longest shorter prefix at which a pair at the threshold shares one in some trie with this probability."""
    floor = FLOOR
    while floor > 1 and (1 - threshold**floor) ** trees > 1 - recall:
        floor -= 1
    return floor


def depths(below: np.ndarray, threshold: float, recall: float) -> np.ndarray:
    """The length of each class's prefix in each trie (classes, trees), at least the floor and at most the depth.

    below: (classes, trees, depth - floor + 1), the classes below the node of each length, ascending lengths.
    """
    n, trees, kinds = below.shape
    longest, lengths = DEPTH, np.arange(DEPTH - kinds + 1, DEPTH + 1)
    miss = np.log1p(-(threshold**lengths))
    # a step shortens by one value; steps of one trie are taken in turn, so a step costs as much as the dearest before it
    cost = np.maximum.accumulate((below[:, :, :-1] - below[:, :, 1:])[:, :, ::-1], axis=2).reshape(n, -1)
    gain = np.broadcast_to((miss[:-1] - miss[1:])[::-1], (n, trees, kinds - 1)).reshape(n, -1)
    nth = np.tile(np.arange(kinds - 1), trees)
    order = np.lexsort((np.broadcast_to(np.repeat(np.arange(trees), kinds - 1), cost.shape), np.broadcast_to(nth, cost.shape), cost))
    reached = trees * miss[-1] + np.cumsum(np.take_along_axis(gain, order, 1), axis=1)
    done = np.concatenate([np.full((n, 1), trees * miss[-1]), reached[:, :-1]], axis=1) <= np.log(max(1 - recall, 1e-300))
    free = np.take_along_axis(cost, order, 1) == 0  # no class more: shorten anyway
    taken = np.zeros(cost.shape, bool)
    np.put_along_axis(taken, order, ~done | free, 1)
    return longest - taken.reshape(n, trees, kinds - 1).sum(2)


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_07)
    return rng.integers(1, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def signatures(hashes: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values of each set (uint32); an empty set has the largest value everywhere."""
    out = np.full((len(offsets) - 1, n), 0xFFFFFFFF, np.uint32)
    full = np.diff(offsets) > 0
    starts = offsets[:-1][full]
    if len(starts):
        low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
        for k, (a, b) in enumerate(zip(*_multipliers(n), strict=True)):
            x = low * a + b
            x ^= high
            x *= np.uint32(0x9E3779B1)
            out[full, k] = np.minimum.reduceat(x ^ (x >> np.uint32(15)), starts)
    return out


def _digests(hashes: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    """Two 64-bit digests of each set."""
    out = np.zeros((2, len(offsets) - 1), np.uint64)
    full = np.diff(offsets) > 0
    if full.any():
        spread = hashes * np.uint64(0xD6E8FEB86659FD93)
        for k, x in enumerate((hashes ^ (hashes >> np.uint64(33)), spread ^ (spread >> np.uint64(29)))):
            out[k, full] = np.add.reduceat(x * np.uint64(0xFF51AFD7ED558CCD), offsets[:-1][full])
    return [pa.array(x.view(np.int64)) for x in out]


def _signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, s1, s2 (digests of the set), n, labels: WIDTH bytes of each of the TREES * DEPTH values."""
    for table in chunks(batches):
        hashes, offsets = shingle_sets(table["text"])
        values = signatures(hashes, offsets, TREES * DEPTH).astype(">u2")
        labels = pa.FixedSizeBinaryArray.from_buffers(pa.binary(values.shape[1] * WIDTH), len(values), [None, pa.py_buffer(values.tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(table["doc_id"].chunks), *_digests(hashes, offsets), pa.array(np.diff(offsets)), labels], ["doc_id", "s1", "s2", "n", "labels"])


def _set_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in chunks(batches):
        hashes, offsets = shingle_sets(table["text"])
        yield pa.RecordBatch.from_arrays([*_digests(hashes, offsets), binaries(hashes, offsets)], ["s1", "s2", "set"])


def _chosen(floor: int, threshold: float, recall: float):
    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """tree, prefix of the nodes to which classes come that are not alone there. nodes: a class's (tree, prefix, n)."""
        for b in batches:
            lists = b["nodes"]
            flat, owner = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            tree, prefix, n = (flat.field(c) for c in ("tree", "prefix", "n"))
            length = pa.compute.binary_length(prefix).to_numpy(zero_copy_only=False) // WIDTH
            below = np.ones((len(lists), TREES, DEPTH - floor + 1), np.int64)
            below[owner, tree.to_numpy(), length - floor] = n.to_numpy()
            own = depths(below, threshold, recall)[owner, tree.to_numpy()] == length
            yield pa.RecordBatch.from_arrays([tree.filter(pa.array(own)), prefix.filter(pa.array(own))], ["tree", "prefix"])

    return choose


def _forest(links: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph with this boolean adjacency matrix."""
    edges, free = [], np.ones(len(links), bool)
    for root in range(len(links)):
        if not free[root]:
            continue
        free[root], todo = False, [root]
        while todo:
            at = todo.pop()
            for j in np.flatnonzero(links[at] & free):
                free[j] = False
                todo.append(int(j))
                edges.append((int(labels[at]), int(labels[j])))
    return edges


def overlaps(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of all sets with all others (or with each other). The matrices are built COLUMNS
    shingles at a time, of those that can be in two sets."""
    both = sets if others is None else sets + others
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    _, column, times = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    kept = times > 1
    if others is not None:
        left = owner < len(sets)
        kept = (np.bincount(column[left], minlength=len(times)) > 0) & (np.bincount(column[~left], minlength=len(times)) > 0)
    shared = np.flatnonzero(kept)
    place = np.full(len(times), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets if others is None else others)), np.float32)
    for low in range(0, len(shared), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((len(both), min(COLUMNS, len(shared) - low)), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        out += part[: len(sets)] @ (part if others is None else part[len(sets) :]).T
    return out


def _compared(rows: list[tuple[int, bool, bytes]], threshold: float) -> list[tuple]:
    """(class, links, null) of each class and (a, null, b) of a spanning forest, for the pairs of two blocks of a group,
    or of one block. rows: class, whether it is in the second block, set."""
    found = {r[:2]: np.frombuffer(r[2], np.uint64) for r in rows}  # a class once, though its text may be repeated
    sides = [sorted(k for k in found if k[1] is second) for second in (False, True)]
    left, right = ([found[k] for k in side] for side in sides)
    if not left or len(left) + len(right) < 2:
        return []
    names = np.array([k[0] for side in sides for k in side])
    a = np.array([len(s) for s in left])
    b = np.array([len(s) for s in right]) if right else a
    if right:
        both = overlaps(left, right)
    else:
        both = overlaps(left)
    close = both >= threshold * (a[:, None] + b[None, :] - both) - 1e-6
    similar = np.zeros((len(names), len(names)), bool)
    if right:
        similar[: len(left), len(left) :] = close
        similar |= similar.T
    else:
        similar = close
        np.fill_diagonal(similar, False)
    count = similar.sum(1)
    out = [(int(r), int(c), None) for r, c in zip(names, count, strict=True) if c]
    return out + [(x, None, y) for x, y in _forest(similar, names)]


def _verify(threshold: float):
    def verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by pair of blocks: each run is compared, then forgotten."""
        key, held, out = None, [], []
        for b in batches:
            columns = [b[c].to_pylist() for c in ("grp", "level", "i", "step", "j", "cid", "second", "set")]
            for *pair, cid, second, data in zip(*columns, strict=True):
                if key != pair:
                    if len(held) > 1:
                        out += _compared(held, threshold)
                    key, held = pair, []
                held.append((cid, second, data))
            if len(out) > 10_000:
                yield _links(out)
                out = []
        if len(held) > 1:
            out += _compared(held, threshold)
        yield _links(out)

    return verified


def _links(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["cid", "links", "other"])


def _groups(heads: DataFrame, threshold: float, recall: float) -> DataFrame:
    """node, component: the candidate groups of heads (cid, labels)."""
    floor = floor_for(threshold, recall)
    size = DEPTH * WIDTH
    labels = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring("labels", t * size + 1, F.lit(size)))
    paths = heads.select("cid", F.posexplode(labels).alias("tree", "label"))
    top = F.substring("label", 1, floor * WIDTH)
    roots = paths.groupBy("tree", top.alias("prefix")).agg(F.min("cid").alias("least"), F.max("cid").alias("most")).where("least != most")
    roots = stage(roots.select("tree", "prefix"), "roots")
    company = paths.withColumn("prefix", top).join(small(roots), ["tree", "prefix"], "left_semi")
    lengths = F.sequence(F.lit(floor * WIDTH), F.lit(size), F.lit(WIDTH))
    # all nodes on the ways of the classes that are not alone below their shortest prefixes
    ways = stage(company.select("cid", "tree", F.explode(F.transform(lengths, lambda k: F.substring("label", F.lit(1), k))).alias("prefix")), "ways")
    nodes = ways.groupBy("tree", "prefix").agg(F.count("*").alias("n"), F.min("cid").alias("least")).where("n > 1")
    nodes = stage(nodes, "nodes")
    met = ways.join(small(nodes), ["tree", "prefix"]).groupBy("cid").agg(F.collect_list(F.struct("tree", "prefix", "n")).alias("nodes"))
    opened = stage(met.select("nodes").mapInArrow(_chosen(floor, threshold, recall), "tree int, prefix binary").distinct(), "opened")
    inside = ways.join(small(opened), ["tree", "prefix"], "left_semi").join(small(nodes), ["tree", "prefix"])
    return components(inside.select(F.col("least").alias("a"), F.col("cid").alias("b")))


def _dealt(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets of members (cid, s1, s2, n, grp, level) for every pair of blocks that is to be compared: grp, level, i, step, j, cid, second, set.

    Sets of levels two apart differ too much in size to be similar. A block is part i of a level; it is compared with
    part j of the same level (step 0) or of the next (step 1).
    """
    per = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.col("n") * 8) / BLOCK_BYTES), F.lit(1)).cast("int")
    parts = members.groupBy("grp", "level").agg(per.alias("m"))
    beside = lambda by, name: parts.select("grp", (F.col("level") + by).alias("level"), F.col("m").alias(name))
    parts = parts.join(beside(-1, "above"), ["grp", "level"], "left").join(beside(1, "under"), ["grp", "level"], "left").na.fill(0)
    parts = stage(parts, "parts")
    cut = members.join(small(parts), ["grp", "level"]).withColumn("block", F.pmod(F.xxhash64("cid"), "m").cast("int"))
    own = sets.join(small(stage(cut, "cut")), ["s1", "s2"])
    some = lambda count, make: F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col(count) - 1, F.lit(0))), make)).otherwise(F.array())
    pair = lambda level, i, step, j, second: F.struct(level.alias("level"), i.alias("i"), step.alias("step"), j.alias("j"), second.alias("second"))
    block, here, zero, one = F.col("block"), F.col("level"), F.lit(0), F.lit(1)
    alike = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: pair(here, F.least(block, o), zero, F.greatest(block, o), block > o))
    pairs = F.concat(alike, some("above", lambda o: pair(here, block, one, o, F.lit(False))), some("under", lambda o: pair(here - 1, o, one, block, F.lit(True))))
    return own.select("grp", "cid", "set", F.explode(pairs).alias("p")).select("grp", "p.level", "p.i", "p.step", "p.j", "cid", "p.second", "set")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, copy_id, n_links: one row for each row of docs (doc_id long, text); other columns are not looked at.

    copy_id: least id of the texts with the same shingles; n_links: how many different sets of shingles have a Jaccard
    similarity of threshold or more with the text's; class_id: least id of all texts that such links connect, which is
    the same for near copies. A text that is null or has no word is alone in its class; a text of fewer than five words
    is one shingle; a text of any length is one set. Repeated rows are copies, and the texts of a repeated id are texts
    of their own. A row without an id belongs to its text's class if that has an id, else to none (null). An empty table
    gives no rows.
    """
    signed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_signed, "doc_id long, s1 long, s2 long, n long, labels binary")
    signed = stage(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")
    worded = signed.where("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    copies = worded.groupBy("s1", "s2").agg(first.alias("first"), F.count("*").alias("copies")).where("copies > 1")
    many = stage(copies.select("s1", "s2", F.col("first.doc_id").alias("rep"), F.col("first.row").alias("cid")), "copies")
    # a class goes by one of its rows: the one with the least id
    placed = signed.join(small(many), ["s1", "s2"], "left").select("doc_id", "row", "s1", "s2", "n", "labels", F.coalesce("cid", "row").alias("cid"), F.coalesce("rep", "doc_id").alias("rep"))
    heads = placed.where("n > 0 and row = cid and rep is not null").select("cid", "rep", "s1", "s2", "n", "labels")
    groups = _groups(heads.select("cid", "labels"), threshold, recall)
    level = F.floor(F.log("n") / np.log(1.001 / threshold)).cast("int")
    members = heads.join(small(groups), F.col("cid") == F.col("node")).select("cid", "rep", "s1", "s2", "n", F.col("component").alias("grp"), level.alias("level"))
    members = stage(members, "members")
    wanted = members.select(F.col("rep").alias("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(wanted), "doc_id", "left_semi")
    sets = stage(texts.mapInArrow(_set_rows, "s1 long, s2 long, set binary"), "sets")
    keys = ["grp", "level", "i", "step", "j"]
    ordered = _dealt(members.drop("rep"), sets).repartition(*keys).sortWithinPartitions(*keys)
    links = stage(ordered.mapInArrow(_verify(threshold), "cid long, links long, other long"), "links")
    count = links.where("links is not null").groupBy("cid").agg(F.sum("links").alias("n_links"))
    joined = components(links.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    known = joined.join(small(members.select(F.col("cid").alias("node"), "rep")), "node")
    least = stage(known.groupBy("component").agg(F.min("rep").alias("class_id")), "class-ids")
    facts = joined.join(small(least), "component").join(count, F.col("node") == F.col("cid"), "left").select("node", "class_id", "n_links")
    out = placed.select("doc_id", "n", "cid", "rep").join(small(stage(facts, "facts")), F.col("cid") == F.col("node"), "left")
    copy = F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.coalesce("class_id", copy).alias("class_id"), copy.alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and links of all documents."""
    tune(spark)
    return jaccard_join(read(spark, sf_dir, "documents").select("doc_id", "text"))

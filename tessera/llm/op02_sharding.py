"""Histogram sort: near-equal shards by bytes, with one exchange of the rows.

Splitters are found by counting. Every open splitter has a bracket of keys; each round counts the exact bytes in
PROBES equal intervals of every bracket over all partitions, and keeps the interval in which the wanted byte offset
falls, until the bytes below a probe are within the tolerance. Only counts, at most shards * PROBES a round, reach
the driver. The key is (hash of the text, doc_id): equal texts are neighbours, and a text with very many copies is
split by doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import packed, read, small, stage, unpacked

SHARDS = 40
#: Probes in each bracket and round.
PROBES = 256
#: Wanted accuracy of a splitter, as a share of one shard's bytes.
TOLERANCE = 0.001
#: Rows alike in both keys that hold more than so many times the wanted accuracy are split too, by a number of each row.
LUMP = 10
#: Rows that one sorting task of the final numbering gets, about.
ROWS_PER_TASK = 50_000
LOW, HIGH = -(2**63), 2**63 - 1


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def _width(low: int, high: int) -> int:
    return max(1, -(-(high - low + 1) // PROBES))


def _counted(rows: DataFrame, brackets: list[tuple]) -> dict[int, list[tuple[int, int, int]]]:
    """Of each bracket, the intervals that have rows: (interval, bytes, rows), ascending.

    A bracket (None, low, high, below) holds the keys hi from low to high, (h, low, high, below) those with hi = h and
    lo from low to high; brackets are disjoint.
    """
    which = F.lit(None).cast("int")
    for k, (hi, low, high, _) in enumerate(brackets):
        inside = F.col("__hi" if hi is None else "__lo").between(F.lit(low).cast("long"), F.lit(high).cast("long"))
        which = F.when(inside if hi is None else inside & (F.col("__hi") == F.lit(hi).cast("long")), F.lit(k)).otherwise(which)
    lo_side = F.col("which").isin([k for k, x in enumerate(brackets) if x[0] is not None])
    # differences of 64-bit keys need 65 bits: decimals stay exact
    exact = lambda x: F.lit(x).cast("decimal(20,0)")
    lows, widths = F.array(*[exact(x[1]) for x in brackets]), F.array(*[exact(_width(x[1], x[2])) for x in brackets])
    key = F.when(lo_side, F.col("__lo")).otherwise(F.col("__hi")).cast("decimal(20,0)")
    at = F.floor((key - F.get(lows, F.col("which"))) / F.get(widths, F.col("which"))).cast("long")
    held = rows.withColumn("which", which).where("which is not null").withColumn("at", at)
    out: dict[int, list[tuple[int, int, int]]] = {k: [] for k in range(len(brackets))}
    for r in held.groupBy("which", "at").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect():
        out[r["which"]].append((r["at"], r["bytes"], r["n"]))
    return {k: sorted(v) for k, v in out.items()}


class Lump(Exception):
    """Many rows that are alike in both keys hold a splitter's offset."""


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """shards - 1 keys (hi, lo), ascending: shard k takes the rows from splitter k - 1 up to before splitter k.

    rows: __hi long, __lo long, size long. A splitter lies within the tolerance of its byte offset, or beside the row
    (or the few rows alike in both keys) that holds the offset.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    wanted = [round(total * k / shards) for k in range(1, shards)]
    if not total:
        return [(HIGH, HIGH)] * len(wanted)
    slack = max(1, int(total / shards * tolerance))
    state: dict[int, tuple] = dict.fromkeys(wanted, (None, LOW, HIGH, 0))
    done: dict[int, tuple[int, int]] = {}
    while state:
        brackets = sorted(set(state.values()), key=str)
        counted = _counted(rows, brackets)
        for w, bracket in list(state.items()):
            hi, low, high, below = bracket
            width, edges, total_here = _width(low, high), [], below
            for at, size, n in counted[brackets.index(bracket)]:
                edges.append((low + at * width, total_here, total_here + size, n))
                total_here += size
            key, before, after, n = next((x for x in edges if x[2] > w), edges[-1])
            end = min(key + width, high + 1)
            place = lambda k, hi=hi: (k, LOW) if hi is None else (hi, k)
            if w - before <= slack or n == 1 and w - before <= after - w:
                done[w] = place(key)
            elif after - w <= slack or n == 1:
                done[w] = place(min(end, HIGH))
            elif end - key > 1:
                state[w] = (hi, key, end - 1, before)
            elif hi is None:  # one text's copies: split them by id
                state[w] = (key, LOW, HIGH, before)
            elif after - before > LUMP * slack:
                raise Lump
            else:  # a few rows alike in both keys
                done[w] = (hi, key) if w - before <= after - w else (hi, min(end, HIGH))
            if w in done:
                del state[w]
    return [done[w] for w in wanted]


def _shard_of(keys: list[tuple[int, int]], offset: int = 0) -> Column:
    """Balanced tree of comparisons: the number of splitters at or below (hi, lo)."""
    if not keys:
        return F.lit(offset)
    mid = len(keys) // 2
    hi, lo = (F.lit(x).cast("long") for x in keys[mid])
    below = (F.col("__hi") < hi) | ((F.col("__hi") == hi) & (F.col("__lo") < lo))
    return F.when(below, _shard_of(keys[:mid], offset)).otherwise(_shard_of(keys[mid + 1 :], offset + mid + 1))


def shard_documents(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """docs with size long, shard int and slot long (0, 1, ... in each shard).

    Law: bytes, the shards' sums of size are near equal. Needs doc_id and text; other columns are kept, whatever their
    names, but that columns named size, shard or slot are replaced. A null text is as good as an empty one (size 16), a
    null doc_id sorts first, and a text of any length is one row of one shard. Many rows alike in text and doc_id are
    split between shards like others. An empty table gives no rows. One exchange moves the rows: to tasks of about
    ROWS_PER_TASK rows within a shard.
    """
    needed, mine = ("doc_id", "text"), ("size", "shard", "slot")
    by_text = F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = packed(docs, needed).withColumns({"size": size_of(), "__hi": by_text, "__lo": F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW).cast("long"))})
    narrow = stage(keyed.select("__hi", "__lo", "size"), "shard-keys")
    try:
        keys = splitters(narrow, shards, tolerance)
    except Lump:  # written once, so that each row keeps its number
        keyed = stage(keyed.withColumn("__lo", F.monotonically_increasing_id()), "shard-rows")
        narrow = stage(keyed.select("__hi", "__lo", "size"), "shard-keys")
        keys = splitters(narrow, shards, tolerance)
    subs = max(1, -(-narrow.count() // (shards * ROWS_PER_TASK)))
    place = {"shard": _shard_of(keys), "__sub": F.pmod(F.xxhash64("__lo", "__hi"), F.lit(subs)).cast("int")}
    placed = keyed.withColumns(place)
    if subs == 1:
        placed = placed.withColumn("__start", F.lit(0))
    else:  # a task numbers its own rows, from the exact count of the tasks before it in the shard
        counts = narrow.withColumns(place).groupBy("shard", "__sub").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("shard").orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1))
        starts = counts.select("shard", "__sub", F.coalesce(before, F.lit(0)).alias("__start"))
        placed = placed.join(small(stage(starts, "shard-starts")), ["shard", "__sub"])
    order = Window.partitionBy("shard", "__sub").orderBy("__hi", "__lo")
    slot = (F.col("__start") + F.row_number().over(order) - 1).cast("long")
    return unpacked(placed.withColumn("slot", slot), docs.columns, needed, mine)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in SHARDS shards under the law of equal bytes."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    crc = docs.withColumn("text_crc32", F.crc32(F.col("text").cast("binary")))
    return shard_documents(crc).select(
        "doc_id", "size", F.col("text_crc32").cast("long").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"),
    )

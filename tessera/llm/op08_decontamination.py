"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A short item inside a long document has a tiny Jaccard similarity with it, so the search compares like with like. Items
are partitioned by size; in each partition the documents are tiled with windows of about a third of an item, of which
an item found in the document covers whole ones, and each window has a MinHash under every hash function. An item's
sliding windows have theirs. A document with a window in common with an item is a candidate, and its exact containment
decides. Everything is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import read, small, stage

#: Words in a shingle, share of an item's shingles that a document must hold, hash functions of a window.
SHINGLE, CONTAINED, FUNCTIONS = 5, 0.8, 2
_NOT_WORD = r"[^\p{L}\p{M}\p{N}_]+"


def words_of(text: str = "text") -> Column:
    """Lower-case runs of letters, marks, digits and underscores."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), _NOT_WORD), "")


def _shingled(array: str, width: int, combine) -> Column:
    """combine(i) for each start i of a run of width elements of the array column."""
    last = F.size(array) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), combine)).otherwise(F.array().cast("array<long>"))


def with_hashes(table: DataFrame, width: int) -> DataFrame:
    """table with __h: the hashes of the text's runs of width words."""
    hashed = table.withColumn("__w", F.transform(words_of(), lambda w: F.xxhash64(w)))
    run = lambda i: F.xxhash64(*[F.get("__w", i + j) for j in range(width)])
    return hashed.withColumn("__h", _shingled("__w", width, run)).drop("__w")


def _hashed(array, f: int) -> Column:
    """The values of hash function f. (Only one argument in the lambda: a second one would be the place.)"""
    return F.transform(array, lambda x: F.xxhash64(x, F.lit(f)))


def _minima(table: DataFrame, windows: list[int]) -> tuple[DataFrame, dict[tuple[int, int], str]]:
    """table with the MinHash of every tile of each window width (powers of two), by (width, function): from the
    tiles of half the width, as least of two."""
    names: dict[tuple[int, int], str] = {}
    table = table.withColumns({f"__m1_{f}": _hashed("__h", f) for f in range(FUNCTIONS)})
    w = 1
    while w <= max(windows):
        names |= {(w, f): f"__m{w}_{f}" for f in range(FUNCTIONS)}
        halves = {f"__m{2 * w}_{f}": f"__m{w}_{f}" for f in range(FUNCTIONS)}

        def tile(name: str) -> Column:
            tiles = F.floor(F.size(name) / 2).cast("int")
            least = lambda j: F.least(F.get(name, j * 2), F.get(name, j * 2 + 1))
            return F.when(tiles > 0, F.transform(F.sequence(F.lit(0), F.greatest(tiles - 1, F.lit(0))), least)).otherwise(F.array().cast("array<long>"))

        w *= 2
        if w <= max(windows):
            table = table.withColumns({new: tile(old) for new, old in halves.items()})
    return table, names


def _item_windows(items: DataFrame, w: int) -> list[Column]:
    """For each function the MinHash of all sliding windows of w shingles of an item."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("__h") - w, F.lit(0)))
    sliding = lambda f: F.transform(starts, lambda i: F.array_min(_hashed(F.slice("__h", i + 1, w), f)))
    return [sliding(f) for f in range(FUNCTIONS)]


def _tagged(minima: Column, w: int, f: int) -> Column:
    return F.transform(minima, lambda x: F.xxhash64(x, F.lit(w * 100 + f)))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = CONTAINED) -> DataFrame:
    """doc_id, item_id, n_shingles, shared, containment of every document that holds threshold of an item's shingles.

    docs: doc_id, text; items: item_id, text; other columns are not looked at. Shingles are runs of five words; an item
    of fewer words is one run of all its words, an item without words is in no document. Texts of any length are compared
    whole. Null texts hold nothing, null ids are ids, and repeated rows are reported once; of several texts of an id the
    pair with the highest containment is reported, of equal ones that with the most shingles. Empty tables give no rows.
    """
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    sized = items.withColumn("__n", F.size(words_of())).where("__n > 0").dropDuplicates(["item_id", "text"])
    width = F.least(F.col("__n"), F.lit(SHINGLE))
    third = (F.col("__n") - width + 2) / 3  # an item of q shingles has q + 1 for 3
    window = F.pow(F.lit(2), F.floor(F.log2(F.greatest(third, F.lit(1.0))))).cast("int")
    sized = stage(sized.select("item_id", "text", width.alias("width"), window.alias("window")), "items")
    parts: dict[int, list[int]] = {}
    for r in sized.select("width", "window").distinct().collect():  # at most five widths and a window for each power of two
        parts.setdefault(r["width"], []).append(r["window"])
    found = None
    for w, windows in sorted(parts.items()):
        own = with_hashes(sized.where(F.col("width") == w), w)
        keys = [
            own.where(F.col("window") == n).select("item_id", F.explode(F.concat(*[_tagged(m, n, f) for f, m in enumerate(_item_windows(own, n))])).alias("key"))
            for n in windows
        ]
        item_keys = keys[0]
        for more in keys[1:]:
            item_keys = item_keys.unionByName(more)
        item_keys = stage(item_keys.distinct(), "item-keys")
        tiled, names = _minima(with_hashes(docs, w), windows)
        doc_keys = tiled.select("doc_id", F.explode(F.concat(*[_tagged(F.col(names[n, f]), n, f) for n in windows for f in range(FUNCTIONS)])).alias("key"))
        pairs = stage(doc_keys.join(small(item_keys), "key").select("doc_id", "item_id").distinct(), "pairs")
        verified = _verify(docs, sized.where(F.col("width") == w), pairs, w, threshold)
        found = verified if found is None else found.unionByName(verified)
    if found is None:
        found = docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, n_shingles int, shared int, containment double")
    return found


def _verify(docs: DataFrame, items: DataFrame, pairs: DataFrame, width: int, threshold: float) -> DataFrame:
    def sets(table: DataFrame) -> DataFrame:
        run = lambda i: F.concat_ws(" ", *[F.get("__w", i + j) for j in range(width)])
        shingles = F.transform(F.sequence(F.lit(0), F.greatest(F.size("__w") - width, F.lit(0))), run)
        return table.withColumn("__w", words_of()).withColumn("__s", F.array_distinct(shingles)).drop("__w", "text")

    # the documents first, one row each with its candidate items, so that no text is copied
    listed = stage(pairs.groupBy(F.col("doc_id").alias("__d")).agg(F.collect_set("item_id").alias("__items"), F.max(F.col("item_id").isNull()).alias("__null")), "candidates")
    held = sets(docs.join(small(listed), F.col("doc_id").eqNullSafe(F.col("__d"))).drop("__d"))
    of_items = stage(sets(items).select(F.col("item_id").alias("__i"), F.col("__s").alias("__t")), "item-sets")
    each = F.explode(F.when(F.col("__null"), F.concat("__items", F.array(F.lit(None)))).otherwise(F.col("__items")))
    joined = held.select("doc_id", "__s", each.alias("item_id")).join(small(of_items), F.col("item_id").eqNullSafe(F.col("__i")))
    shared = F.size(F.array_intersect("__s", "__t"))
    counted = joined.select("doc_id", "item_id", F.size("__t").alias("n_shingles"), shared.alias("shared"))
    scored = counted.withColumn("containment", F.col("shared") / F.col("n_shingles")).where(F.col("containment") >= threshold)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shingles", "shared")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_shingles", "b.shared", "b.containment")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))

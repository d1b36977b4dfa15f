"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact token length. A source takes every document a whole number of times, and
fills the rest of its budget from those counts: of a large budget first the same share of every length, then a
bounded-knapsack dynamic programme over the last DP_WORDS words. Which documents of a length are
taken is decided by a seeded hash of the id.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import packed, read, small, stage, unpacked

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
#: Words that the dynamic programme may still have to place: its table has so many bits.
DP_WORDS = 200_000
#: Documents of one length and source that one task ranks, about.
ROWS_PER_TASK = 1_000


def size_of(text: str = "text") -> Column:
    """Number of maximal runs of characters other than space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, most: int = MOST_REPEATS) -> list[tuple[str | None, float]]:
    """Words wanted from each source. Sources by code point, null last, weigh weights in turn and share all words;
    no target is above most times its source's size, and the excess is shared anew by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = [weights[k % len(weights)] for k in range(len(order))]
    total, out, free = float(sum(n for _, n in order)), [0.0] * len(order), set(range(len(order)))
    left = total
    while free:
        share = left / sum(weight[k] for k in free)
        over = [k for k in free if share * weight[k] > most * order[k][1]]
        if not over:
            for k in free:
                out[k] = share * weight[k]
            break
        for k in over:
            out[k] = float(most * order[k][1])
            left -= out[k]
            free.discard(k)
    return [(s, out[k]) for k, (s, _) in enumerate(order)]


def fit(budget: int, counts: dict[int, int]) -> dict[int, int]:
    """How many documents of each length to take, so that their words come as near to budget as possible.

    counts: documents by length, of positive lengths. Of two results as near, the smaller one is taken.
    """
    all_words = sum(n * c for n, c in counts.items())
    if budget >= all_words:
        return dict(counts)
    # a large budget: the same share of every length, but for what the programme handles
    even = max(0, budget - DP_WORDS // 2)
    take = {n: c * even // all_words for n, c in counts.items()}
    left = budget - sum(n * c for n, c in take.items())
    # largest remainders first, while more is missing than the programme handles
    for n in sorted(counts, key=lambda n: (-((counts[n] * even) % all_words), -n)):
        if left <= DP_WORDS:
            break
        if n <= left and take[n] < counts[n]:
            take[n] += 1
            left -= n
    # bounded knapsack: bit w of reach says whether w more words can be had. Counts are split in powers of two.
    # Up to one shortest document more than what is left may be nearer than less.
    top = left + min((n for n in counts if take[n] < counts[n]), default=0)
    mask, reach, steps = (1 << (top + 1)) - 1, 1, []
    for n in sorted(counts):
        spare, part = min(counts[n] - take[n], top // n), 1
        while spare > 0 and not reach >> left & 1:
            part = min(part, spare)
            before, reach = reach, (reach | reach << (n * part)) & mask
            if reach != before:
                steps.append((n, part, before))
            spare, part = spare - part, part * 2
    at, above = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1, reach >> left
    over = (above & -above).bit_length() - 1 if above else None
    if over is not None and over < left - at:
        at = left + over
    for n, part, before in reversed(steps):
        if not before >> at & 1:
            take[n] += part
            at -= n * part
    return take


def _fit_source(target_of: dict):
    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        source = pdf["source"].iloc[0]
        source = None if source is None or source != source else source
        counts = dict(zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True))
        words = sum(n * c for n, c in counts.items())
        target = target_of[source]
        whole = min(MOST_REPEATS, int(target // words)) if words else 0
        rest = fit(round(target) - whole * words, {n: c for n, c in counts.items() if n}) if words and whole < MOST_REPEATS else {}
        return pd.DataFrame({
            "source": pd.Series([source] * len(counts), dtype=object), "size": list(counts), "n": list(counts.values()),
            "whole": whole, "extra": [rest.get(n, 0) for n in counts], "source_size": words, "target": float(target),
        })

    return fitted


def mix(docs: DataFrame, seed: int = 7, weights=WEIGHTS) -> DataFrame:
    """docs with size long, source_size long, target double and times int: how often the mix takes the document.

    Needs doc_id, text and source; other columns are kept, whatever their names, but that columns of the four names are
    replaced. Documents without words are taken 0 times; a text of any length is counted whole. A null source is a source
    of its own; null ids and rows alike in all columns are ranked by their hash, and ties by an arbitrary but whole choice
    of rows: the number taken is exact. An empty table gives no rows.
    """
    spark, mine, needed = docs.sparkSession, ("size", "source_size", "target", "times"), ("doc_id", "text", "source")
    # rows alike in id are told apart by their text, so that they don't go to one part
    rank = F.xxhash64(F.lit(seed), "doc_id", "text")
    sized = packed(docs, needed).withColumns({"__size": size_of(), "__rank": rank})
    narrow = stage(sized.select(F.col("source").alias("__s"), F.col("__size").alias("__n"), "__rank"), "mix-sizes")
    hist = narrow.groupBy("__s", "__n").agg(F.count("*").alias("n"))
    # one row for a source; the targets need all of them at once
    by_source = [(r["__s"], r["words"]) for r in hist.groupBy("__s").agg(F.sum(F.col("n") * F.col("__n")).alias("words")).collect()]
    target_of = dict(targets(by_source, weights))
    schema = "source string, size long, n long, whole int, extra long, source_size long, target double"
    counts = hist.select(F.col("__s").alias("source"), F.col("__n").alias("size"), "n")
    plan = stage(counts.groupBy("source").applyInPandas(_fit_source(target_of), schema), "mix-plan")
    # lengths with many documents are ranked in parts, by the hash: whole parts first, then within one part
    parts = F.ceil(F.col("n") / ROWS_PER_TASK).cast("long")
    lengths = small(plan.select(F.col("source").alias("__s2"), F.col("size").alias("__n2"), F.struct("whole", "extra", "source_size", "target").alias("__plan"), parts.alias("__parts")))

    def with_plan(rows: DataFrame, source: str, size: str) -> DataFrame:
        found = rows.join(lengths, F.col(source).eqNullSafe(F.col("__s2")) & (F.col(size) == F.col("__n2"))).drop("__s2", "__n2")
        return found.withColumn("__part", F.pmod(F.shiftrightunsigned("__rank", 1), F.col("__parts")).cast("int"))

    dealt = with_plan(narrow, "__s", "__n").groupBy("__s", "__n", "__part").agg(F.count("*").alias("m"), F.first("__plan.extra").alias("extra"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("__s", "__n").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = F.greatest(F.lit(0), F.least(F.col("m"), F.col("extra") - before)).cast("long")
    quotas = stage(dealt.select(F.col("__s").alias("__s2"), F.col("__n").alias("__n2"), F.col("__part").alias("__p2"), "m", quota.alias("__quota")), "mix-quotas")
    rows = with_plan(sized, "source", "__size").join(
        small(quotas), F.col("source").eqNullSafe(F.col("__s2")) & (F.col("__size") == F.col("__n2")) & (F.col("__part") == F.col("__p2"))
    )
    # only parts that are taken in part need an order: of the others all rows are taken, or none
    open_part = (F.col("__quota") > 0) & (F.col("__quota") < F.col("m"))
    nth = F.row_number().over(Window.partitionBy("source", "__size", "__part").orderBy("__rank", "doc_id"))
    ranked = rows.where(open_part).withColumn("__extra", (nth <= F.col("__quota")).cast("int"))
    out = rows.where(~open_part).withColumn("__extra", (F.col("__quota") > 0).cast("int")).unionByName(ranked)
    times = F.when(F.col("__size") > 0, F.col("__plan.whole") + F.col("__extra")).otherwise(F.lit(0)).cast("int")
    facts = {"size": F.col("__size"), "source_size": F.col("__plan.source_size"), "target": F.col("__plan.target"), "times": times}
    return unpacked(out.withColumns(facts), docs.columns, needed, mine)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by the weights 1, 2, 3 in turn."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "source", "times")

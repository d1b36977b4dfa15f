"""Line-range blocks of a file: splitting, diagnostics, and the normal form that tiles lines 1 to N."""

from __future__ import annotations

import heapq
import re
import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths

_BLOCK = "struct<start_line:int,end_line:int,title:string,kind:string,symbols:array<string>>"
#: Contract of a splitter: blocks of a file, characters of a title and a kind, symbols of a block, at most.
MOST_BLOCKS, TITLE, KIND, SYMBOLS = 50, 120, 32, 20


def structural(text: str) -> list[dict]:
    """Stand-in splitter: blocks begin at headings, definitions, and after blank lines, at most MOST_BLOCKS of them."""
    lines = text.split("\n")
    head = re.compile(r"^(#{1,6}\s|(export\s+|public\s+|private\s+|static\s+|async\s+)*(class|def|func|function|fn|interface|enum|struct|trait|impl|module|package|create\s+table)\b)", re.IGNORECASE)
    starts = [i for i, line in enumerate(lines) if i == 0 or head.match(line) or (not lines[i - 1].strip() and line.strip())]
    starts = _merged(starts, len(lines), MOST_BLOCKS)
    out = []
    for start, end in zip(starts, [*starts[1:], len(lines)], strict=True):
        block = "\n".join(lines[start:end])
        names = list(dict.fromkeys(re.findall(r"\b(?:class|def|func|function|fn|interface|enum|struct|trait|table)\s+([A-Za-z_]\w*)", block, re.IGNORECASE)))[:SYMBOLS]
        title = next((line.strip() for line in lines[start:end] if line.strip()), "logic")[:TITLE]
        kind = "heading" if title.startswith("#") else "definition" if names else "logic_block"
        out.append({"start_line": start + 1, "end_line": end, "title": title, "kind": kind, "symbols": names})
    return out


def _merged(starts: list[int], end: int, most: int) -> list[int]:
    """starts without those whose block makes the smallest one with the block before, until most are left; ties to the first."""
    n = len(starts)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    edge = lambda i: starts[i] if i < n else end
    size = lambda i: edge(after[i]) - starts[before[i]]
    heap, kept = [(size(i), i) for i in range(1, n)], [True] * n
    heapq.heapify(heap)
    left = n
    while left > most:
        width, i = heapq.heappop(heap)
        if not kept[i] or width != size(i):  # an older entry
            continue
        kept[i], left = False, left - 1
        after[before[i]] = after[i]
        if after[i] < n:
            before[after[i]] = before[i]
            heapq.heappush(heap, (size(after[i]), after[i]))
        if before[i] > 0:
            heapq.heappush(heap, (size(before[i]), before[i]))
    return [s for s, k in zip(starts, kept, strict=True) if k]


def checked(found: list[dict]) -> list[dict]:
    """A splitter's blocks if they keep the contract, else ValueError."""
    if not isinstance(found, list) or not 1 <= len(found) <= MOST_BLOCKS:
        raise ValueError(f"a splitter returns 1 to {MOST_BLOCKS} blocks")
    for b in found:
        if set(b) != {"start_line", "end_line", "title", "kind", "symbols"}:
            raise ValueError(f"a block has other keys: {sorted(b)}")
        if len(b["title"]) > TITLE or len(b["kind"]) > KIND or len(b["symbols"]) > SYMBOLS:
            raise ValueError("a block's title, kind or list of symbols is too long")
    return found


def split_with(splitter=structural):
    """Column function: text -> array of blocks, by a Python splitter (a model's client, or the stand-in)."""

    # pickled, as its batches are of 100 rows, and Arrow's of 10,000 whole texts
    return F.udf(lambda t: None if t is None else checked(splitter(t)), f"array<{_BLOCK}>", useArrow=False)


def split_apart(splitter=structural):
    """Column function: text -> (blocks, seconds, error). A splitter that fails for one file is that file's error only."""

    def split(text: str | None) -> tuple[list[dict] | None, float, str | None]:
        started, found, error = time.perf_counter(), None, None
        try:
            found = checked(splitter(text)) if text is not None else []
        except Exception as e:  # noqa: BLE001  any reason is the file's own
            error = f"{type(e).__name__}: {e}"
        return found, time.perf_counter() - started, error

    return F.udf(split, f"blocks array<{_BLOCK}>, seconds double, error string", useArrow=False)


def once(value: Column, use) -> Column:
    """use(value), with value computed once for a row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _ordered(blocks: Column) -> Column:
    """By start and end; equal ranges keep their order."""
    placed = F.transform(blocks, lambda b, i: F.struct(b["start_line"].alias("start_line"), b["end_line"].alias("end_line"), i.alias("place"), b["title"].alias("title"), b["kind"].alias("kind"), b["symbols"].alias("symbols")))
    return F.array_sort(placed)


def _block(start: Column, end: Column, of: Column) -> Column:
    return F.struct(start.alias("start_line"), end.alias("end_line"), of["title"].alias("title"), of["kind"].alias("kind"), of["symbols"].alias("symbols"))


def normalised(blocks: Column | str, total: Column | str) -> Column:
    """Blocks that tile lines 1 to total: clamped, gaps halved between neighbours (the odd line goes left), overlaps
    given to the earlier block, empty ones dropped. Without any block, one block logic over all lines."""
    blocks, total = (F.col(x) if isinstance(x, str) else x for x in (blocks, total))
    zero = F.struct(F.array().cast(f"array<{_BLOCK}>").alias("out"), F.lit(0).alias("end"))

    def merge(state: Column, b: Column) -> Column:
        out, before = state["out"], state["end"]
        start, end = F.greatest(F.lit(1), b["start_line"]), F.least(b["end_line"], total)
        first, gap = F.size(out) == 0, start > before + 1
        middle = F.floor((before + start) / 2).cast("int")
        begin = F.when(first, F.lit(1)).when(gap, middle + 1).otherwise(F.greatest(start, before + 1))
        last = F.try_element_at(out, F.size(out))
        stretched = F.when(first | ~gap, out).otherwise(F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(_block(last["start_line"], middle, last))))
        # a gap moves the end of the block before even if this block is dropped, but not the end that is remembered
        kept = F.struct(F.concat(stretched, F.array(_block(begin, end, b))).alias("out"), end.alias("end"))
        dropped = F.struct(stretched.alias("out"), before.alias("end"))
        return F.when(start > end, state).when(begin > end, dropped).otherwise(kept)

    def closed(done: Column) -> Column:
        last = F.try_element_at(done, F.size(done))
        tiles = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(_block(last["start_line"], F.greatest(last["end_line"], total), last)))
        return F.when(F.coalesce(F.size(done), F.lit(0)) == 0, default).otherwise(tiles)

    default = F.array(F.struct(F.lit(1).alias("start_line"), total.alias("end_line"), F.lit("logic").alias("title"), F.lit("logic_block").alias("kind"), F.array().cast("array<string>").alias("symbols")))
    return once(F.aggregate(_ordered(blocks), zero, merge)["out"], closed)


def coverage(blocks: Column | str, total: Column | str) -> Column:
    """Share of the lines in blocks, in per cent, at most 100; 0 for no lines."""
    blocks, total = (F.col(x) if isinstance(x, str) else x for x in (blocks, total))
    covered = F.aggregate(blocks, F.lit(0), lambda a, b: a + b["end_line"] - b["start_line"] + 1)
    return F.when(total == 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), covered / total * 100))


def diagnostics(blocks: DataFrame, key: str = "path") -> DataFrame:
    """Per file: blocks, whether unsorted, bounds broken, gaps, overlaps, and raw coverage (which ignores gaps).

    blocks: key, place (order given), start_line, end_line, total; one row for a block.
    """
    order = Window.partitionBy(key).orderBy("start_line", "end_line", "place")
    before = F.coalesce(F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = F.greatest(before, F.lit(0))
    marked = blocks.withColumn("before", before).withColumn("nth", F.row_number().over(order)).withColumn("given", F.row_number().over(Window.partitionBy(key).orderBy("place")))
    gap = F.when(F.col("start_line") > F.col("before") + 1, F.col("start_line") - 1 - F.col("before"))
    overlap = F.when(F.col("start_line") <= F.col("before"), F.col("before") - F.col("start_line") + 1)
    top = F.greatest(F.max("end_line"), F.lit(0))
    tail = F.greatest(F.max("total") - top, F.lit(0))
    grouped = marked.withColumns({"gap": gap, "overlap": overlap}).groupBy(key).agg(
        F.count("*").alias("blocks"), F.max(F.col("nth") != F.col("given")).alias("unsorted"),
        F.sum((F.col("start_line") < 1).cast("long")).alias("starts_out"), F.sum((F.col("end_line") > F.col("total")).cast("long")).alias("ends_out"),
        (F.count("gap") + (tail > 0).cast("long")).alias("gaps"), (F.coalesce(F.sum("gap"), F.lit(0)) + tail).cast("long").alias("gap_lines"),
        F.count("overlap").alias("overlap_count"), F.coalesce(F.sum("overlap"), F.lit(0)).cast("long").alias("overlap_lines"),
        F.when(F.max("total") == 0, F.lit(0.0)).otherwise(F.least(top, F.max("total")) / F.max("total") * 100).alias("raw_coverage"),
    )
    return grouped


def chunks(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One row for each normalised block of files (path, text, blocks): key, ordinal, lines, text, size, symbols."""
    tiles = lambda own: once(normalised("blocks", F.size(own)), lambda t: F.transform(t, lambda b, i: piece(own, t, b, i)))

    def piece(own: Column, t: Column, b: Column, i: Column) -> Column:
        cut = F.array_join(F.slice(own, b["start_line"], b["end_line"] - b["start_line"] + 1), "\n")
        return F.struct((i + 1).alias("chunk_id"), F.size(t).alias("chunks"), b.alias("b"), cut.alias("text"), F.size(own).alias("total"))

    # cut before the rows are made, so that a text is split into lines once and goes into no row of its chunks
    each = files.select(path, F.explode(once(paths.lines(text), tiles)).alias("__c"))
    return each.select(
        paths.chunk_key(path, "__c.chunk_id", "__c.chunks").alias("id"), path, "__c.chunk_id", "__c.chunks",
        F.col("__c.b.start_line").alias("start_line"), F.col("__c.b.end_line").alias("end_line"), F.col("__c.text").alias("text"),
        F.octet_length("__c.text").cast("long").alias("size"), F.col("__c.total").alias("file_lines"), F.col("__c.b.title").alias("title"),
        F.col("__c.b.kind").alias("kind"), F.array_distinct("__c.b.symbols").alias("symbols"),
    )

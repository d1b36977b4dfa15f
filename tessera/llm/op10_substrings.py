"""Substring deduplication: passages of WORDS words or more that several documents hold, byte for byte.

1. Texts are cut in variable chunks by their content: a chunk begins at the word before which a gear rolling hash is the
   least of SPAN words in a row. An inserted word moves the cuts near it only, and every passage of WORDS words holds
   whole chunks, the same ones wherever it stands.
2. Chunks are deduplicated by digest over all documents: those that several documents hold are shared.
3. Only a window of WORDS words whose own chunks are all shared can be in two documents. The digests of these windows,
   which are the exact check, are counted; overlapping repeated windows are one passage, so its ends are exact to the word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import read, small, stage, tune
from tessera.llm.textarrays import chunks, flat, mixed

#: Bytes that the gear hash sees; a repeated passage has at least so many whole words.
WINDOW, WORDS = 16, 50
#: Words of which one begins a chunk. As 50 words hold 42 that have WINDOW bytes of them before, twice as many as SPAN,
#: two of them begin chunks, and the chunk between is whole.
SPAN = 21
#: A word of more bytes (a script without spaces, say) is cut into words where so many bits of the hash are zero.
UNBROKEN, BITS = 256, 4
#: Windows that are joined at once.
ROWS = 200_000
_GEAR = np.random.default_rng(10_16).integers(0, 1 << 16, 256, dtype=np.uint16)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash of the WINDOW bytes up to each byte."""
    h, step = _GEAR[data], 1
    while step < WINDOW:  # twice as many bytes with each step
        older = np.zeros_like(h)
        older[step:] = h[:-step]
        h = h + (older << np.uint16(step))
        step *= 2
    return h


def words_of(data: np.ndarray, starts: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and text of every word. data: texts in a row, starts: their first bytes (ascending, in data), h: gear(data).

    A word is a run of bytes above the space; one of more than UNBROKEN bytes is cut between characters, by content.
    """
    space = data <= 32
    opens, closes = np.concatenate([[True], space[:-1]]), np.concatenate([space[1:], [True]])
    opens[starts] = True
    closes[starts[1:] - 1] = True
    begin, end = np.flatnonzero(~space & opens), np.flatnonzero(~space & closes) + 1
    if len(begin) and (end - begin).max() > UNBROKEN:
        cut = np.flatnonzero((h >> np.uint16(16 - BITS)) == 0) + 1
        cut = cut[cut < len(data)]
        run = np.searchsorted(begin, cut, side="right") - 1
        cut = cut[(run >= 0) & (cut - begin[run] >= WINDOW) & (cut < end[run]) & (end[run] - begin[run] > UNBROKEN) & ((data[cut] & 0xC0) != 0x80)]
        cut = cut[np.diff(cut, prepend=-WINDOW) >= WINDOW]  # not everywhere in text of one letter
        begin, end = np.union1d(begin, cut), np.union1d(end, cut)
    return begin, end, np.searchsorted(starts, begin, side="right") - 1


def chunk_starts(begin: np.ndarray, text: np.ndarray, starts: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words at which chunks begin (ascending), and for each word the one that begins a chunk among it and the
    SPAN - 1 after it, where they are of one text (else -1). The other arguments are as words_of() has them."""
    own = h[np.maximum(begin - 1, 0)].astype(np.uint64)
    own[begin - starts[text] < WINDOW] = 1 << 16  # the hash would see the text before
    place = np.arange(len(begin), dtype=np.uint64)
    least, step = own << np.uint64(40) | np.uint64((1 << 40) - 1) - place, 1  # of equal ones the last
    while step < SPAN:  # the minimum over twice as many words with each step
        more = min(step, SPAN - step)
        least = np.minimum(least[:-more], least[more:])
        step += more
    chosen = np.full(len(begin), -1)
    whole = np.flatnonzero(text[: len(least)] == text[SPAN - 1 :])
    chosen[whole] = (1 << 40) - 1 - (least[whole] & np.uint64((1 << 40) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(text, prepend=-1) > 0)
    return np.union1d(first, chosen[whole]), chosen


def _digests(data: np.ndarray, begin: np.ndarray) -> Callable[[np.ndarray, np.ndarray, bool], tuple[np.ndarray, np.ndarray]]:
    """A function of words a and b that gives 128 bits, as two arrays, of the bytes from the first one of a to the end of
    word b - 1; whole: with the space after it."""
    data, begin = data[begin[0] :], begin - begin[0]
    length = np.diff(np.append(begin, len(data)))
    power = np.cumprod(np.full(int(length.max()), _BASES[0], np.uint64))
    terms = (data.astype(np.uint64) + np.uint64(1)) * power[np.arange(len(data)) - np.repeat(begin, length)]
    spaced = np.add.reduceat(terms, begin)
    terms[data <= 32] = 0
    last, n, parts = np.add.reduceat(terms, begin), len(begin), []
    for base in _BASES:
        up, down = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, x, np.uint64))) for x in (base, pow(base, -1, 1 << 64)))
        parts.append((np.append(np.zeros(1, np.uint64), np.cumsum(mixed(spaced ^ np.uint64(base)) * up[:n])), mixed(last ^ np.uint64(base)), up, down))

    def digest(a: np.ndarray, b: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for sums, bare, up, down in parts:
            x = (sums[b if whole else b - 1] - sums[a]) * down[a]
            found.append(mixed(x if whole else x + bare[b - 1] * up[b - 1 - a]).view(np.int64))
        return found[0], found[1]

    return digest


class _Cut:
    """The words, chunks and digests of texts in a row."""

    def __init__(self, data: np.ndarray, starts: np.ndarray) -> None:
        h = gear(data)
        self.begin, self.end, self.text = words_of(data, starts, h)
        self.cuts, self.chosen = chunk_starts(self.begin, self.text, starts, h) if len(self.begin) >= WORDS else (np.zeros(0, int), np.zeros(0, int))
        self.digest = _digests(data, self.begin) if len(self.begin) >= WORDS else None

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text and digest of each chunk."""
        return self.text[self.cuts], *self.digest(self.cuts, np.append(self.cuts[1:], len(self.begin)), True)

    def windows(self, shared: np.ndarray) -> np.ndarray:
        """First words of the windows of WORDS words in one text whose chunks are all shared (a flag of each chunk)."""
        at = np.flatnonzero(self.text[: 1 - WORDS] == self.text[WORDS - 1 :])
        # the first word of which the hash sees nothing before the window, and the chunks from there on
        inner = np.searchsorted(self.begin, self.begin[at] + WINDOW)
        first, last = self.chosen[inner], self.chosen[at + WORDS - SPAN]
        a, b = np.searchsorted(self.cuts, first), np.searchsorted(self.cuts, last)
        known = np.append(0, np.cumsum(shared))
        unsure = (inner + SPAN > at + WORDS) | (b <= a)  # words of one byte without spaces: no chunk need be whole
        return at[unsure | (known[np.maximum(a, b)] - known[a] == b - a)]


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, _Cut]]:
    """Tables without empty texts, the first bytes of their texts, and their words and chunks."""
    for table in chunks(batches):
        table = table.filter(pc.greater(pc.binary_length(table["text"]), 0))
        if not table.num_rows:
            continue
        texts = flat(table["text"].cast(pa.large_string()))
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        starts = ends[:-1] - ends[0]
        cut = _Cut(np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]], starts)
        if cut.digest is not None:
            yield table, starts, cut


def _chunk_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """d1, d2, doc_id, copied: the chunks of every document that can hold a passage."""
    for table, _, cut in _texts(batches):
        text, d1, d2 = cut.chunks()
        long = np.bincount(cut.text, minlength=table.num_rows)[text] >= WORDS
        at = pa.array(text[long])
        yield pa.RecordBatch.from_arrays([pa.array(d1[long]), pa.array(d2[long]), flat(table["doc_id"]).take(at), flat(table["copied"]).take(at)], ["d1", "d2", "doc_id", "copied"])


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """w1, w2, doc_id, copied, nth, at: the windows whose chunks are among the document's shared ones.

    nth packs version (31 bits) and the window's place (32), at packs its first byte (31) and bytes (32).
    """
    for table, starts, cut in _texts(batches):
        lists = flat(table["shared"])
        owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        of_text = lambda d, texts: d.view(np.uint64) ^ mixed(texts.astype(np.uint64) + np.uint64(1))
        text, d1, _ = cut.chunks()
        at = cut.windows(np.isin(of_text(d1, text), of_text(lists.flatten().to_numpy(zero_copy_only=False), owner)))
        text = cut.text[at]
        start, stop = cut.begin[at] - starts[text], cut.end[at + WORDS - 1] - starts[text]
        # places count from the text's own first word
        nth = at - np.searchsorted(cut.text, text)
        w1, w2 = cut.digest(at, at + WORDS, False)
        version = table["version"].to_numpy()[text]
        owner = pa.array(text)
        yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), flat(table["doc_id"]).take(owner), flat(table["copied"]).take(owner), pa.array(version << 32 | nth), pa.array(start << 32 | stop - start)], ["w1", "w2", "doc_id", "copied", "nth", "at"])


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive by document, version and place: overlapping windows are joined."""
    held: list[np.ndarray] = []
    size, most = 0, ROWS
    for b in batches:
        doc, nth, at, first, again = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        low = (1 << 32) - 1
        held.append(np.column_stack([doc, nth >> 32, nth & low, at >> 32, (at >> 32) + (at & low), first, again]))
        size += b.num_rows
        if size >= most:
            rows = np.concatenate(held)
            edges = _edges(rows)
            yield _spans([s for a, e in pairwise(edges[:-1]) for s in _joined(rows[a:e])])
            held, size = [rows[edges[-2] :]], len(rows) - edges[-2]  # the last document may go on
            most = max(ROWS, 2 * size)
    if size:
        rows = np.concatenate(held)
        yield _spans([s for a, e in pairwise(_edges(rows)) for s in _joined(rows[a:e])])


def _edges(rows: np.ndarray) -> list[int]:
    """First rows of each document and version, and the end."""
    return [0, *(np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1).tolist(), len(rows)]


def _joined(rows: np.ndarray) -> list[tuple]:
    """The spans of one document, split where the least first holder of the windows on a word changes.

    rows: doc_id, version, nth, start, end, first_doc and again of its windows.
    """
    rows = rows[np.append(True, rows[1:, 2] != rows[:-1, 2])]  # repeated rows of docs
    doc, version, (nth, start, end, first, again) = int(rows[0, 0]), int(rows[0, 1]), rows[:, 2:].T
    cuts = np.flatnonzero((np.diff(nth) > WORDS) | (np.diff(first) != 0) | (np.diff(again) != 0)) + 1
    # windows in a row of one first holder: who, first word and the word after, first byte and end
    runs = [(int(first[a]), int(again[a]), int(nth[a]), int(nth[e - 1]) + WORDS, int(start[a]), int(end[e - 1])) for a, e in pairwise([0, *cuts.tolist(), len(nth)])]
    base = int(nth[0])
    holder = np.full(int(nth[-1]) + WORDS - base, -1)  # of each word
    for k in sorted(range(len(runs)), key=lambda k: (-runs[k][0], -runs[k][1])):
        holder[runs[k][2] - base : runs[k][3] - base] = k
    held = holder >= 0
    source, later = (np.array([r[x] for r in runs])[holder] for x in (0, 1))
    edges = np.flatnonzero((held[1:] != held[:-1]) | (held[1:] & ((source[1:] != source[:-1]) | (later[1:] != later[:-1])))) + 1
    opens, closes = {r[2]: r[4] for r in runs}, {r[3]: r[5] for r in runs}
    out = []
    for a, e in pairwise([0, *edges.tolist(), len(holder)]):
        if held[a]:
            # spans that touch share the byte between them: where the next run begins, or else where the last one ends
            left = opens[a + base] if a + base in opens else closes[a + base]
            goes_on = e < len(holder) and held[e]
            right = opens[e + base] if goes_on and e + base in opens else closes[e + base]
            out.append((doc, left, right - left, e - a, int(source[a]), int(source[a]) != doc or bool(later[a]), version))
    return out


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "start", "bytes", "words", "first_doc_id", "removed", "version"])


def repeated_spans(docs: DataFrame, within: bool = False) -> DataFrame:
    """doc_id, start, bytes, words, first_doc_id, removed: every repeated passage of every document.

    docs: doc_id long, text; other columns are not looked at. start and bytes are in UTF-8 bytes and cover whole words.
    first_doc_id is the least document that holds a window on the word; removed is false where that is the document
    itself. A passage is split where it changes, so a part can be short, but each word lies in a passage of WORDS words.
    Every removed word is in a window of a document with a lesser id, so one copy of it stays. Passages that only one
    document holds are none, unless within is set: then they are repeated too, and removed but for the first.
    Null and empty texts and rows without an id have none; repeated rows count as one; a text of any length is read
    whole; an empty table gives no rows. Words of more than UNBROKEN bytes count as several (see words_of).
    """
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if within:
        rows = rows.distinct()
    cleanup, session = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", docs.sparkSession
    before = session.conf.get(cleanup)
    session.conf.set(cleanup, "true")  # what is staged needs no shuffle files
    columns = ["doc_id", "start", "bytes", "words", "first_doc_id", "removed"]
    try:
        # of equal texts only that of the least document is searched: all of it is repeated, and the others have its passages
        named = rows.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(10), "text")})
        listed = stage(named.select("doc_id", "t1", "t2"), "texts")
        copied = listed.groupBy("t1", "t2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least != last")
        copied = stage(copied.select("t1", "t2", "least"), "copied-texts")
        version = F.col("t1").bitwiseAND(F.lit((1 << 31) - 1)).alias("version")
        others = stage(listed.join(small(copied), ["t1", "t2"]).where("doc_id != least").select("doc_id", F.col("least").alias("of"), version).distinct(), "copies")
        own = named.join(small(copied), ["t1", "t2"], "left").where("least is null or doc_id = least").select("doc_id", version, "text", F.col("least").isNotNull().alias("copied"))
        windows, repeated = _counted(own, within)
        mine = windows.join(small(repeated), ["w1", "w2"])
        again = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("nth") != F.col("first.nth")) if within else F.lit(False)
        ordered = mine.select("doc_id", "nth", "at", F.col("first.doc_id").alias("first_doc"), again.cast("long").alias("again")).repartition("doc_id").sortWithinPartitions("doc_id", "nth")
        spans = stage(ordered.mapInArrow(_runs, "doc_id long, start long, bytes long, words long, first_doc_id long, removed boolean, version long"), "spans")
    finally:
        session.conf.set(cleanup, before)
    as_copies = spans.withColumnRenamed("doc_id", "of").drop("removed").join(small(others), ["of", "version"]).withColumn("removed", F.lit(True))
    return spans.select(*columns).unionByName(as_copies.select(*columns))


def _counted(rows: DataFrame, within: bool) -> tuple[DataFrame, DataFrame]:
    """The windows that can be repeated, and the digests that are, with their first holders; both are staged.

    rows: doc_id, version, text, copied (whether other documents have the text).
    """
    cut = stage(rows.mapInArrow(_chunk_rows, "d1 long, d2 long, doc_id long, copied boolean"), "chunks")
    many = F.max("copied") | (F.count("*") > 1 if within else F.min("doc_id") != F.max("doc_id"))
    shared = stage(cut.groupBy("d1", "d2").agg(many.alias("many")).where("many").select("d1", "d2"), "shared-chunks")
    of_doc = stage(cut.join(small(shared), ["d1", "d2"]).groupBy("doc_id").agg(F.collect_set("d1").alias("shared")), "document-chunks")
    likely = rows.join(small(of_doc), "doc_id").select("doc_id", "version", "text", "copied", "shared")
    windows = stage(likely.mapInArrow(_windows, "w1 long, w2 long, doc_id long, copied boolean, nth long, at long"), "windows")
    first = F.min(F.struct("doc_id", "nth")) if within else F.struct(F.min("doc_id").alias("doc_id"))
    held = windows.groupBy("w1", "w2").agg(first.alias("first"), many.alias("many")).where("many")
    return windows.drop("copied"), stage(held.select("w1", "w2", "first"), "repeated")


def without_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the removed passages cut out of text."""
    cuts = spans.where("removed").groupBy(F.col("doc_id").alias("__d")).agg(F.sort_array(F.collect_set(F.struct("start", "bytes"))).alias("__cuts"))
    joined = docs.join(cuts, docs["doc_id"] == cuts["__d"], "left")
    raw = F.col("text").cast("binary")
    part = lambda a, n: F.decode(F.substring(raw, (a + 1).cast("int"), n.cast("int")), "UTF-8")
    zero = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))
    kept = F.aggregate("__cuts", zero, lambda s, c: F.struct(F.concat(s["text"], part(s["at"], c["start"] - s["at"])).alias("text"), (c["start"] + c["bytes"]).alias("at")))
    cut = F.concat(kept["text"], part(kept["at"], F.octet_length("text") - kept["at"]))
    return joined.withColumn("text", F.when(F.col("__cuts").isNull(), F.col("text")).otherwise(cut)).select(*docs.columns)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents."""
    tune(spark)
    return repeated_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))

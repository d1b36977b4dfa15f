"""Cross-entropy difference: how much nearer a document is to a target corpus than to the background.

Both are interpolated bigram models of words over one vocabulary, that of all documents: the target counts the documents
labelled as good, the background all others, scaled to the target's size, so that equal counts mean the same in both. A
document is scored without its own counts. Each token's difference of losses is summed over the document.

All n-grams are counted, so what is counted grows with the corpus, and no task or driver holds it. Texts are read in
chunks; a chunk sends each of its n-grams once, with its counts, to the n-gram's bucket, gets the totals back, and scores
its documents. A frequent n-gram is thus one entry of a chunk, however many documents have it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import read, small, stage, tune
from tessera.llm.textarrays import NOT_WORD, WORD_CHUNK_BYTES, Tokens, chunks, code_points, mixed, word_hashes

#: Bytes of text for each bucket of n-grams, about.
BUCKET_BYTES = 16 << 20
#: Weight of the bigram after a frequent word, occurrences of a word at which it has half of that, added to each word's count.
WEIGHT, HALF, ADDED = 0.8, 1.0, 0.5
_BOUNDARY = np.uint64(0x5851F42D4C957F2D)
_CHUNK = "chunk long, ids binary, offsets binary, words binary, n_target long, n_rest long, members array<boolean>"
_ENTRY = "chunk long, bucket int, keys binary, target binary, rest binary"


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


class _Grams:
    """The n-grams of a chunk: its words by number, then its bigrams. A document is its words between boundaries, which
    are one mark, the last number."""

    def __init__(self, words: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> None:
        """words: hashes; ids: the word at each token; offsets: first token of each document, and the end."""
        sizes = np.diff(offsets)
        some, n = sizes > 0, len(words)
        self.sizes = np.where(some, sizes + 1, 0)  # the closing mark is a token too
        self.owner = np.repeat(np.arange(len(sizes)), self.sizes)
        ends = np.cumsum(self.sizes)[some] - 1
        self.token = np.full(len(self.owner), n)
        inside = np.ones(len(self.owner), bool)
        inside[ends] = False
        self.token[inside] = ids
        self.before = np.append(n, self.token[:-1]) if len(self.token) else self.token  # each document follows a mark
        hashes = np.append(words, _BOUNDARY)
        code, self.bigram = np.unique(self.before * (n + 1) + self.token, return_inverse=True)
        pair = mixed(hashes[code // (n + 1)] * np.uint64(0x9E3779B97F4A7C15) + hashes[code % (n + 1)])
        self.keys = np.concatenate([hashes | np.uint64(1), pair & ~np.uint64(1)])  # a word's key is odd
        self.words = n + 1

    def counts(self, flags: np.ndarray) -> np.ndarray:
        """How often each n-gram is in the documents with a flag."""
        own = flags[self.owner]
        return np.concatenate([np.bincount(self.token[own], minlength=self.words), np.bincount(self.bigram[own], minlength=len(self.keys) - self.words)])

    def dealt(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams ordered by bucket, and the first of each bucket and the end."""
        bucket = (self.keys >> np.uint64(1)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(buckets + 1))

    def own(self, of_token: np.ndarray) -> np.ndarray:
        """For each token, how often its document has what of_token says of it."""
        _, which, times = np.unique(self.owner * (int(of_token.max(initial=0)) + 1) + of_token, return_inverse=True, return_counts=True)
        return times[which]


def _gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk: its words, and its documents' tokens."""
    for nth, table in enumerate(chunks(batches, most=WORD_CHUNK_BYTES)):
        tokens, members = Tokens(table["text"], NOT_WORD), np.array(table["in_target"].to_pylist(), bool)
        sizes = np.diff(tokens.offsets) + (np.diff(tokens.offsets) > 0)
        row = {
            "chunk": TaskContext.get().partitionId() << 32 | nth, "ids": _packed(tokens.ids.astype(np.int32)), "offsets": tokens.offsets.astype(np.int64).tobytes(),
            "words": word_hashes(*code_points(tokens.vocab)).tobytes(), "n_target": int(sizes[members].sum()), "n_rest": int(sizes[~members].sum()), "members": members.tolist(), "doc_ids": table["doc_id"].to_pylist(),
        }
        schema = pa.schema([("chunk", pa.int64()), *((c, pa.binary()) for c in ("ids", "offsets", "words")), ("n_target", pa.int64()), ("n_rest", pa.int64()), ("members", pa.list_(pa.bool_())), ("doc_ids", pa.list_(table.schema.field("doc_id").type))])
        yield from pa.Table.from_pylist([row], schema).to_batches()


def _grams_of(row: dict) -> _Grams:
    offsets = np.frombuffer(row["offsets"], np.int64)
    return _Grams(np.frombuffer(row["words"], np.uint64), _unpacked(row["ids"], int(offsets[-1]), np.int32).astype(np.int64), offsets)


def _entries(buckets: int):
    def enter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each chunk and bucket: the chunk's n-grams in it."""
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                grams, members = _grams_of(row), np.array(row["members"], bool)
                order, edges = grams.dealt(buckets)
                keys, target, rest = grams.keys[order], grams.counts(members)[order], grams.counts(~members)[order]
                full = np.flatnonzero(np.diff(edges))
                parts = [slice(edges[b], edges[b + 1]) for b in full]
                columns = [[keys[p].tobytes() for p in parts], [_packed(target[p]) for p in parts], [_packed(rest[p]) for p in parts]]
                yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]] * len(parts), pa.int64()), pa.array(full, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], ["chunk", "bucket", "keys", "target", "rest"])

    return enter


def _total(rows: pa.Table) -> pa.Table:
    """The totals of a bucket's n-grams, for each chunk in its order, and the number of different words (chunk -1)."""
    held = [np.frombuffer(k.as_py(), np.uint64) for k in rows["keys"]]
    sizes = [len(k) for k in held]
    keys, which = np.unique(np.concatenate(held), return_inverse=True)
    out = []
    for name in ("target", "rest"):
        counts = np.concatenate([_unpacked(x.as_py(), n, np.int64) for x, n in zip(rows[name], sizes, strict=True)])
        totals = np.bincount(which, weights=counts, minlength=len(keys)).astype(np.int64)[which]
        out.append([_packed(x) for x in np.split(totals, np.cumsum(sizes)[:-1])] + [b""])
    bucket = rows["bucket"][0].as_py()
    return pa.table({
        "chunk": pa.array([*rows["chunk"].to_pylist(), -1], pa.int64()), "bucket": pa.array([bucket] * (len(sizes) + 1), pa.int32()),
        "target": pa.array(out[0], pa.binary()), "rest": pa.array(out[1], pa.binary()), "different": pa.array([0] * len(sizes) + [int((keys & np.uint64(1)).sum())], pa.int64()),
    })


def losses(grams: _Grams, totals: np.ndarray, without: np.ndarray, whole: int, scale: float, different: int) -> np.ndarray:
    """The loss of each token. totals: of each n-gram; without: whether its document is counted in them, for each token;
    whole: tokens in the totals; scale: what a count is worth; different: words of the vocabulary."""
    single, double = totals[: grams.words], totals[grams.words :]
    mine = lambda of_token: np.where(without, grams.own(of_token), 0)
    word, before = (scale * (single[x] - mine(x)) for x in (grams.token, grams.before))
    both = scale * (double[grams.bigram] - mine(grams.bigram))
    left = scale * (whole - np.where(without, grams.sizes[grams.owner], 0))
    alone = (word + ADDED) / (left + ADDED * different)
    weight = WEIGHT * before / (before + HALF)
    return -np.log(weight * both / np.maximum(before, 1e-300) + (1 - weight) * alone)


def score_against_target(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ce_target, ce_background, ce_corpus, score: one row for each row of docs (doc_id, text, in_target).

    The cross-entropies are nats a token (word, or the end of the text) under the target, the background and all documents
    together, each without the row itself; score is that of the target less that of the background (lower: nearer the
    target). A text that is null or has no word has no tokens, and 0.0 in all; a null in_target is false. A text of any
    length is scored whole. Repeated rows and ids, null ones too, are rows of their own, so a copy of a text is known to
    the models: ce_corpus is low. Other columns are not looked at. An empty table gives no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce("in_target", F.lit(False)).alias("in_target"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    # written, so that a chunk has the same documents whenever it is read
    gathered = stage(rows.mapInArrow(_gather, f"{_CHUNK}, doc_ids array<{id_type}>"), "lm-chunks")
    entries = gathered.select("chunk", "ids", "offsets", "words", "members").mapInArrow(_entries(buckets), _ENTRY)
    totals = stage(entries.groupBy("bucket").applyInArrow(lambda t: _total(t), "chunk long, bucket int, target binary, rest binary, different long"), "lm-totals")
    found = gathered.agg(F.sum("n_target").alias("t"), F.sum("n_rest").alias("b")).first()
    in_target, in_rest = found["t"] or 0, found["b"] or 0
    different = totals.agg(F.sum("different").alias("n")).first()["n"] or 0
    scale = in_target / in_rest if in_target and in_rest else 1.0
    names = ["doc_id", "n_tokens", "ce_target", "ce_background", "ce_corpus", "score"]

    def score(own: pa.Table, parts: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        grams = _grams_of(row)
        order, edges = grams.dealt(buckets)
        known = np.zeros((2, len(grams.keys)), np.int64)
        for part in parts.to_pylist():
            at = order[edges[part["bucket"]] : edges[part["bucket"] + 1]]
            known[:, at] = [_unpacked(part[c], len(at), np.int64) for c in ("target", "rest")]
        member = np.array(row["members"], bool)[grams.owner]
        n = grams.sizes
        mean = lambda x: np.bincount(grams.owner, weights=x, minlength=len(n)) / np.maximum(n, 1)
        t = mean(losses(grams, known[0], member, in_target, 1.0, different))
        b = mean(losses(grams, known[1], ~member, in_rest, scale, different))
        c = mean(losses(grams, known.sum(0), np.ones(len(member), bool), in_target + in_rest, 1.0, different))
        ids = own["doc_ids"].chunk(0).flatten()
        return pa.Table.from_arrays([ids, *map(pa.array, (n.astype(np.int64), t, b, c, t - b))], names)

    chunk = gathered.select("chunk", "ids", "offsets", "words", "members", "doc_ids").groupBy("chunk")
    reply = totals.where("chunk >= 0").select("chunk", "bucket", "target", "rest").groupBy("chunk")
    return chunk.cogroup(reply).applyInArrow(lambda a, b: score(a, b), f"doc_id {id_type}, n_tokens long, ce_target double, ce_background double, ce_corpus double, score double")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the documents labelled with quality 1."""
    tune(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = docs.join(small(read(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("in_target", F.lit(True))), "doc_id", "left")
    return score_against_target(labelled)

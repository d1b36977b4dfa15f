"""Toxic passages by maximum-scoring segment search, calibrated by extreme values.

A token's score is its log-odds between toxic and clean labelled documents, with Dirichlet priors in a hierarchy: four
letters of the word, five, six, seven, the word; each level's prior has the odds of the level above. DRIFT is taken off, so
that the mean is negative. A linear-time scan finds every maximal segment of a text; Karlin-Altschul statistics of the
clean documents turn a segment's score into an expected number of such segments by chance, and a logistic fit turns the
sum of the significant segments' evidence into the probability of the label.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import held_out, read, small, tune
from tessera.llm.textarrays import NOT_LETTERS, Tokens, chunks, code_points, word_hashes

#: Labelled documents of each class that the model is fitted on, about; every CALIBRATE-th of them only calibrates.
PER_CLASS, CALIBRATE = 6_000, 5
#: Letters of the levels (None: the word), pseudo-documents of each prior, what is taken off the log-odds.
LEVELS, PRIOR, DRIFT = (4, 5, 6, 7, None), 6.0, 1.0
#: Sampled documents that have a feature, at least: rarer ones say nothing, and their words have the odds of the level above.
FEWEST = 3
#: Segments count that are expected at most so often by chance in a text.
EXPECTED = 0.05
#: A document with this score or more is predicted toxic.
THRESHOLD = 0.3
_BIN, _BINS = 0.25, 80


def features(vocab: pa.Array) -> list[np.ndarray]:
    codes, lengths = code_points(vocab)
    return [word_hashes(codes, lengths, n) ^ np.uint64(0 if n is None else n) for n in LEVELS]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score), in order: those that no longer segment with a higher score
    contains and whose own parts all score less. Linear in the number of scores."""
    ends = np.cumsum(scores)
    found: list[list] = []  # first, end, sum before it, sum with it, index of the last one before with a smaller sum before
    for i in np.flatnonzero(scores > 0).tolist():
        new = [i, i + 1, float(ends[i] - scores[i]), float(ends[i]), -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new[0], new[2] = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right, _ in found]


def _compressed(evidence: float) -> float:
    """Evidence for the logistic fit: even far values of it then have some influence, but no more."""
    return math.asinh(evidence)


class Model:
    """tables: for each level sorted feature hashes and the log-odds of each."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.tables = tables
        self.rate, self.k, self.slope, self.shift = 1.0, 1.0, 1.0, 0.0

    def token_scores(self, vocab: pa.Array) -> np.ndarray:
        out = np.zeros(len(vocab))
        for (keys, odds), wanted in zip(self.tables, features(vocab) if len(vocab) else [], strict=False):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                out = np.where(keys[at] == wanted, odds[at], out)
        return out - DRIFT

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> tuple[float, list[tuple[int, int, float, float]]]:
        """Evidence of the whole text, and (first, end, score, expected by chance) of the significant segments."""
        fixed = math.log(self.k * max(n, 1))
        logs = [(a, b, s, self.rate * s - fixed) for a, b, s in segments]
        most = max((x for *_, x in logs), default=-fixed)
        sure = [x for x in logs if x[3] >= -math.log(EXPECTED)]
        return most + sum(x for *_, x in sure) - (max((x for *_, x in sure), default=0.0)), [(a, b, s, math.exp(-min(x, 700))) for a, b, s, x in sure]

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * _compressed(evidence) + self.shift))))

    def calibrate(self, rows: list[tuple[int, int, list[float], float]], bins: np.ndarray) -> None:
        """rows: (toxic, tokens, scores of all segments, weight); bins: clean tokens by score. Sets the extreme-value and logistic parameters."""
        middle, share = (np.arange(_BINS) - _BINS // 2) * _BIN, bins / max(1, bins.sum())
        moment = lambda x: float((share * np.exp(np.minimum(x * middle, 600))).sum()) - 1
        low, high = 1e-3, 4.0
        if moment(high) > 0:
            for _ in range(60):
                mid = (low + high) / 2
                low, high = (mid, high) if moment(mid) <= 0 else (low, mid)
        self.rate = max(high, 0.05)
        gumbel = [self.rate * max(s) - math.log(n) for toxic, n, s, _ in rows if not toxic and n and s]
        self.k = math.exp(min(5.0, max(-12.0, float(np.mean(gumbel)) - 0.5772))) if len(gumbel) >= 30 else 1e-3
        positive = sum(r[0] for r in rows)
        if not 0 < positive < len(rows):  # one class only: no evidence moves the score from its share
            self.slope, self.shift = 0.0, math.log((positive + 0.1) / (len(rows) - positive + 1))
            return
        x = np.array([_compressed(self.evidence([(0, 0, v) for v in s], n)[0]) for _, n, s, _ in rows])
        y, w = np.array([r[0] for r in rows], float), np.array([r[3] for r in rows])
        w = w / w.mean()
        design, ridge = np.column_stack([np.ones(len(x)), x]), np.array([1e-3, 1e-2])

        def loss(b: np.ndarray) -> float:
            z = design @ b
            return float(w @ (np.logaddexp(0, z) - y * z) + ridge @ (b * b) / 2)

        beta = np.array([math.log((y @ w + 1) / ((1 - y) @ w + 1)), 0.1])
        for _ in range(100):  # Newton steps, halved until the loss falls
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
            hessian = design.T @ (design * (w * p * (1 - p))[:, None]) + np.diag(ridge)
            step, scale = np.linalg.solve(hessian, design.T @ (w * (y - p)) - ridge * beta), 1.0
            while scale > 1e-6 and loss(beta + scale * step) > loss(beta):
                scale /= 2
            beta = beta + scale * step
            if scale * float(np.abs(step).max()) < 1e-6:
                break
        self.shift, self.slope = float(beta[0]), max(1e-3, float(beta[1]))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that have a feature."""
    for table in chunks(batches):
        tokens = Tokens(table["text"], NOT_LETTERS)
        if not len(tokens.vocab):
            continue
        toxic = np.array(table["toxic"].to_pylist(), bool)
        owner = np.repeat(np.arange(table.num_rows), np.diff(tokens.offsets))
        for level, hashes in enumerate(features(tokens.vocab)):
            keys, which = np.unique(hashes, return_inverse=True)
            pairs = np.unique(owner * len(keys) + which[tokens.ids])
            at, positive = pairs % len(keys), toxic[pairs // len(keys)]
            yes = np.bincount(at[positive], minlength=len(keys))
            no = np.bincount(at[~positive], minlength=len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), level, np.int32)), pa.array(keys.view(np.int64)), pa.array(yes), pa.array(no)], ["level", "key", "yes", "no"])


def fit(labelled: DataFrame, per_class: int = PER_CLASS) -> Model:
    """labelled: doc_id, text, toxic (0, 1). Null texts or labels teach nothing, equal texts count once for each label.

    The model, and the scores of the segments of the documents that calibrate, are as large as the sample allows.
    """
    spark = labelled.sparkSession
    rows = labelled.where("toxic is not null and text is not null").select("doc_id", "text", (F.col("toxic") > 0).alias("toxic"))
    sizes = {bool(r["toxic"]): r["count"] for r in rows.groupBy("toxic").count().collect()}
    shares = {t: min(1.0, per_class / n) for t, n in sizes.items()}
    spot, of_text = (F.pmod(F.xxhash64(*c, F.lit(3)), F.lit(1_000_000)) for c in (["doc_id"], ["text", "toxic"]))
    limit = F.when(F.col("toxic"), F.lit(int(shares.get(True, 0) * 1_000_000))).otherwise(F.lit(int(shares.get(False, 0) * 1_000_000)))
    sample = rows.where(spot < limit).withColumn("apart", F.pmod(of_text, F.lit(CALIBRATE)) == 0)  # copies stay on one side
    counts = sample.where("not apart").dropDuplicates(["text", "toxic"]).select("text", "toxic").mapInArrow(_count, "level int, key long, yes long, no long")
    held = counts.groupBy("level", "key").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).where(F.col("yes") + F.col("no") >= FEWEST).toArrow()
    level, keys, yes, no = (held[c].to_numpy() for c in ("level", "key", "yes", "no"))
    # rates of the two classes are compared, so the sizes of the samples cancel out
    ratio = max(1.0, shares.get(True, 0) * sizes.get(True, 0)) / max(1.0, shares.get(False, 0) * sizes.get(False, 0))
    tables = []
    for k in range(len(LEVELS)):
        own = level == k
        order = np.argsort(keys[own].view(np.uint64))
        tables.append((keys[own].view(np.uint64)[order], yes[own][order].astype(float), no[own][order] * ratio))
    model = Model([(t[0], np.zeros(len(t[0]))) for t in tables])
    shared = spark.sparkContext.broadcast(tables)

    # a feature's parent is known only through words: look the parents up where the words are
    def parents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches):
            tokens = Tokens(table["text"], NOT_LETTERS)
            if len(tokens.vocab):
                found = features(tokens.vocab)
                for k in range(1, len(LEVELS)):
                    keys, first = np.unique(found[k], return_index=True)
                    kept = np.isin(keys, shared.value[k][0])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(kept.sum()), k, np.int32)), pa.array(keys[kept].view(np.int64)), pa.array(found[k - 1][first][kept].view(np.int64))], ["level", "key", "parent"])

    above = sample.where("not apart").select("text").mapInArrow(parents, "level int, key long, parent long").groupBy("level", "key").agg(F.min("parent").alias("parent")).toArrow()
    a_level, a_key, a_parent = (above[c].to_numpy() for c in ("level", "key", "parent"))
    shares_of: list[np.ndarray] = []
    for k, (keys_k, y, n) in enumerate(tables):
        prior = np.full(len(keys_k), 0.5)
        if k and len(keys_k):
            own = a_level == k
            order = np.argsort(a_key[own].view(np.uint64))
            child, parent = a_key[own].view(np.uint64)[order], a_parent[own].view(np.uint64)[order]
            up = parent[np.minimum(np.searchsorted(child, keys_k), len(child) - 1)]
            at = np.minimum(np.searchsorted(tables[k - 1][0], up), len(tables[k - 1][0]) - 1)
            prior = np.where(tables[k - 1][0][at] == up, shares_of[k - 1][at], 0.5)
        shares_of.append((y + PRIOR * prior) / (y + n + PRIOR))
        model.tables[k] = (keys_k, np.log(shares_of[k] / (1 - shares_of[k])))
    ready = spark.sparkContext.broadcast(model)

    seen_type = pa.schema([("toxic", pa.int64()), ("n", pa.int64()), ("s", pa.list_(pa.float64())), ("bins", pa.list_(pa.int64()))])

    def observe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches):
            tokens = Tokens(table["text"], NOT_LETTERS)
            scores = ready.value.token_scores(tokens.vocab)
            toxic = table["toxic"].to_pylist()
            out: list[tuple] = []
            for i, is_toxic in enumerate(toxic):
                own = scores[tokens.ids[tokens.offsets[i] : tokens.offsets[i + 1]]]
                bins = np.bincount(np.clip(np.round(own / _BIN) + _BINS // 2, 0, _BINS - 1).astype(int), minlength=_BINS)
                out.append((int(is_toxic), len(own), [s for *_, s in maximal_segments(own)], bins.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*out, strict=True)], ["toxic", "n", "s", "bins"]).cast(seen_type)

    seen = sample.where("apart").select("text", "toxic").mapInArrow(observe, "toxic long, n long, s array<double>, bins array<long>").toArrow().to_pylist()
    bins = sum((np.array(r["bins"]) for r in seen if not r["toxic"]), np.zeros(_BINS))
    weight = {t: 1 / max(shares.get(bool(t), 1.0), 1e-9) for t in (0, 1)}
    model.calibrate([(r["toxic"], r["n"], r["s"], weight[r["toxic"]]) for r in seen], bins)
    return model


PASSAGES = "array<struct<first:int,end:int,score:double,expected:double,words:string>>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score double (0 to 1), predicted int and passages, for every row.

    passages: first and end token (words of letters), score, expected number by chance, and the words in lower case, of
    every significant segment. A null or empty text has none, and the score of a text without evidence; a text of any
    length is scanned whole. Repeated rows and ids, null ones too, give repeated rows; columns of docs named as the three
    are replaced, others are kept; an empty table gives no rows.
    """
    mine = ("score", "predicted", "passages")
    kept = [c for c in docs.columns if c not in mine]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema), f"score double, predicted int, passages {PASSAGES}"])
    arrow = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64()), ("words", pa.string())]))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for table in chunks(batches):
            tokens = Tokens(table["text"], NOT_LETTERS)
            by_word = model.token_scores(tokens.vocab)
            hot = tokens.sums(by_word > 0)
            scores, passages = [], []
            for i in range(table.num_rows):
                a, b = int(tokens.offsets[i]), int(tokens.offsets[i + 1])
                segments = maximal_segments(by_word[tokens.ids[a:b]]) if a < b and hot[i] else []
                evidence, sure = model.evidence(segments, b - a)
                scores.append(model.probability(evidence))
                passages.append([(f, e, s, x, " ".join(tokens.vocab.take(pa.array(tokens.ids[a + f : a + e])).to_pylist())) for f, e, s, x in sure])
            flags = pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())
            out = [pa.concat_arrays(table[c].chunks) for c in kept] + [pa.array(scores, pa.float64()), flags, pa.array([[dict(zip(("first", "end", "score", "expected", "words"), p, strict=True)) for p in ps] for ps in passages], arrow)]
            yield pa.RecordBatch.from_arrays(out, [*kept, *mine])

    return docs.select(*kept).mapInArrow(scan, schema)


def learned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """Fitted on the labelled documents of docs that are not held out; of several labels of an id the highest counts."""
    labels = read(spark, sf_dir, "labels").where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return fit(docs.where(~held_out()).select("doc_id", "text").join(small(labels), "doc_id"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    tune(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, learned(spark, docs, sf_dir))
    spans = F.transform("passages", lambda p: F.struct(p["first"].alias("first"), p["end"].alias("end"), p["expected"].alias("expected")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", spans.alias("passages"))

"""Language identification by interpolated Kneser-Ney character models, with calibrated rejection.

A text gets the language whose model has the lowest cross-entropy per character. A language's texts are rejected above
the REJECT quantile of that cross-entropy over learning documents that were kept out of the counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.charlm import CharLM, count_grams
from tessera.llm.shared import held_out, read, tune
from tessera.llm.textarrays import NOT_LETTERS, WORD_CHUNK_BYTES, Tokens, chunks, pieces

#: Learning documents of a language that the models are fitted on, about; every CALIBRATE-th of them only sets thresholds.
PER_LANGUAGE, CALIBRATE = 2_000, 5
REJECT = 0.995
#: Documents from which a language has some that set its threshold.
LEAST = 10
#: The confidence is the posterior that this many characters of the text give, at most, so that long texts don't all get 1.
CHARACTERS = 40


class Identifier:
    def __init__(self, model: CharLM, limits: dict[str, float]) -> None:
        self.model, self.limits = model, np.array([limits.get(c, np.inf) for c in model.classes])

    def predict(self, column: pa.ChunkedArray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language (und without letters), confidence, cross-entropy in nats a character, rejected."""
        n, total = np.zeros(len(column)), np.zeros((len(column), len(self.model.classes)))
        for texts, rows in pieces(column):
            tokens = Tokens(texts, NOT_LETTERS)
            logs, sizes = self.model.score(tokens.vocab)
            n[rows] += tokens.sums(sizes.astype(np.float64))
            total[rows] += tokens.sums(logs)
        ce = -total / np.maximum(n, 1)[:, None]
        best = ce.argmin(1)
        low = ce[np.arange(len(ce)), best]
        odds = np.exp(-(ce - low[:, None]) * np.minimum(n, CHARACTERS)[:, None])
        none = n == 0
        names = np.where(none, "und", np.array(self.model.classes)[best])
        return names.tolist(), np.where(none, 0.0, 1 / odds.sum(1)), np.where(none, 0.0, low), none | (low > self.limits[best])


def learn(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Identifier | None:
    """labelled: doc_id, text, lang. Languages that are null teach nothing; None if there is no language at all. Every
    language with a word in its documents is learned, however few they are.

    The models are fitted on about per_language documents of each language, chosen by a hash of the id.
    """
    spark = labelled.sparkSession
    rows = labelled.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for a language
    if not sizes:
        return None
    spot = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000))
    limit = F.coalesce(*[F.when(F.col("lang") == c, F.lit(int(min(1.0, per_language / n) * 1_000_000))) for c, n in sizes.items()])
    # a language with few documents is learned from all of them, and rejects nothing
    enough = F.col("lang").isin([c for c, n in sizes.items() if n >= LEAST])
    apart = enough & (F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(CALIBRATE)) == 0)
    sample = rows.where(spot < limit).select("text", F.col("lang").alias("class"), apart.alias("apart"))
    counts = count_grams(sample.where("not apart"), NOT_LETTERS)
    seen = sorted(r["class"] for r in counts.select("class").distinct().collect())
    if not seen:
        return None
    model = CharLM.from_counts(counts, seen)
    shared = spark.sparkContext.broadcast(Identifier(model, {}))

    def entropies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, most=WORD_CHUNK_BYTES):
            names, _, ce, _ = shared.value.predict(table["text"])
            right = np.array(names) == np.array(table["class"].to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(names)[right]), pa.array(ce[right])], ["class", "ce"])

    kept = sample.where("apart").mapInArrow(entropies, "class string, ce double")
    limits = {r["class"]: r["q"] for r in kept.groupBy("class").agg(F.percentile_approx("ce", REJECT, 10_000).alias("q")).collect()}
    return Identifier(model, limits)


def identify(docs: DataFrame, known: Identifier | None) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, rejected: one row for each row of docs (doc_id, text).

    und with score 0 for a text that is null or has no letter, or if nothing was learned. lang_pred is the nearest
    language even if rejected. A text of any length is scored whole. Repeated rows and ids, null ones too, give repeated
    rows; ties go to the first language by name. Other columns are not looked at; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, most=WORD_CHUNK_BYTES):
            n = table.num_rows
            found = shared.value.predict(table["text"]) if shared.value else (["und"] * n, np.zeros(n), np.zeros(n), np.ones(n, bool))
            ids = pa.concat_arrays(table["doc_id"].chunks)
            yield pa.RecordBatch.from_arrays([ids, pa.array(found[0], pa.string()), *map(pa.array, found[1:])], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {id_type}, lang_pred string, score double, cross_entropy double, rejected boolean")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    tune(spark)
    docs = read(spark, sf_dir, "documents")
    known = learn(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs, known).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")

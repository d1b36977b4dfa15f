"""Interpolated Kneser-Ney models over the characters of words, one for each class, in shared sorted hash arrays.

A word is its characters between start marks and an end mark. The counts come from Spark as the n-grams of the highest
order; lower orders use continuation counts. Every order keeps a sorted array of hashes with one row of
log-probabilities for each class, so that one lookup serves all classes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import stage
from tessera.llm.textarrays import WORD_CHUNK_BYTES, Tokens, chunks, code_points, pieces

ORDER = 5
#: N-grams that a worker handles at once.
ROWS = 1 << 17
_START, _END = 2, 3
_Q = 0xD6E8FEB86659FD93


def _grams(vocab: pa.Array, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first word, number of rows of each word from it on, rows), about ROWS rows at a time; a word of more comes in parts.

    A row is a character and the order - 1 before it; there is one for each character and end mark.
    """
    ends = np.cumsum(pa.compute.utf8_length(vocab).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    word = 0
    while word < len(vocab):
        stop = max(word + 1, int(np.searchsorted(ends, (ends[word - 1] if word else 0) + ROWS, side="right")))
        codes, lengths = code_points(vocab.slice(word, stop - word))
        starts = np.cumsum(lengths + order) - (lengths + order)
        padded = np.full(int((lengths + order).sum()), _START, np.uint32)
        mark = np.zeros(len(padded), bool)
        mark[(starts[:, None] + np.arange(order - 1)).ravel()] = True
        scored = np.flatnonzero(~mark)
        padded[starts + order - 1 + lengths] = _END
        mark[starts + order - 1 + lengths] = True
        padded[~mark] = codes
        for low in range(0, len(scored), ROWS):
            part = scored[low : low + ROWS]
            yield word, lengths + 1 if len(scored) <= ROWS else np.array([len(part)]), padded[part[:, None] + np.arange(1 - order, 1)]
        word = stop


def _keys(columns: np.ndarray, order: int) -> np.ndarray:
    """Hash of the last order columns; minus the last column it is the hash of the context."""
    h = np.zeros(len(columns), np.uint64)
    for j in range(order):
        h = h + columns[:, -1 - j].astype(np.uint64) * np.uint64(pow(_Q, j, 1 << 64))
    return h


def _counter(order: int, separator: str):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, most=WORD_CHUNK_BYTES):
            for name in table["class"].unique().to_pylist():
                for texts, _ in pieces(table.filter(pa.compute.equal(table["class"], name))["text"]):
                    tokens = Tokens(texts, separator)
                    times = np.bincount(tokens.ids, minlength=len(tokens.vocab))
                    for word, rows, columns in _grams(tokens.vocab, order):
                        _, first, which = np.unique(_keys(columns, order), return_index=True, return_inverse=True)
                        n = np.bincount(which, weights=np.repeat(times[word : word + len(rows)], rows)).astype(np.int64)
                        text = np.ascontiguousarray(columns[first]).view(f"<U{order}").ravel()
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), pa.array(text.tolist(), pa.string()), pa.array(n)], ["class", "gram", "n"])

    return count


def count_grams(docs: DataFrame, separator: str, order: int = ORDER) -> DataFrame:
    """class string, gram string, n long: exact counts over all docs (class string, text string)."""
    rows = docs.where("class is not null and text is not null").mapInArrow(_counter(order, separator), "class string, gram string, n long")
    return stage(rows.groupBy("class", "gram").agg(F.sum("n").alias("n")), "grams")


class CharLM:
    def __init__(self, classes: list[str], grams: np.ndarray, counts: np.ndarray) -> None:
        """grams: distinct n-grams as rows of code points, counts: one column for each class."""
        self.classes, self.order = classes, grams.shape[1]
        self.probs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.backoff: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        levels, columns, held = {}, grams, counts.astype(np.float64)
        for k in range(self.order, 0, -1):
            keys, first, which = np.unique(_keys(columns, k), return_index=True, return_inverse=True)
            summed = np.zeros((len(keys), len(classes)))
            np.add.at(summed, which, held)
            columns = columns[first]
            levels[k] = (keys, columns, summed)
            held = (summed > 0).astype(np.float64)  # a lower order counts the distinct characters before it
        self.base = -np.log(len(levels[1][0]) + 1)
        below = None
        for k in range(1, self.order + 1):
            keys, columns, n = levels[k]
            contexts, which = np.unique(keys - columns[:, -1].astype(np.uint64), return_inverse=True)
            total, kinds = np.zeros((len(contexts), len(classes))), np.zeros((len(contexts), len(classes)))
            np.add.at(total, which, n)
            np.add.at(kinds, which, n > 0)
            once, twice = (n == 1).sum(0), (n == 2).sum(0)
            discount = np.clip(np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5), 0.1, 0.95)
            gamma = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            lower = np.exp(self.base) if below is None else below[1][np.searchsorted(below[0], _keys(columns, k - 1))]
            p = np.maximum(n - discount, 0) / np.maximum(total, 1)[which] + gamma[which] * lower
            below = (keys, p)
            self.probs[k], self.backoff[k] = (keys, np.log(p).astype(np.float32)), (contexts, np.log(gamma).astype(np.float32))

    @classmethod
    def from_counts(cls, counts: DataFrame, classes: list[str], order: int = ORDER) -> CharLM:
        """counts: the rows of count_grams(). Their number is that of the distinct n-grams of characters."""
        table = counts.where(F.length("gram") == order).groupBy("gram").pivot("class", classes).agg(F.sum("n")).na.fill(0, classes).toArrow()
        grams = np.frombuffer("".join(table["gram"].to_pylist()).encode("utf-32-le"), dtype="<u4").reshape(-1, order)
        return cls(classes, grams, np.column_stack([table[c].to_numpy() for c in classes]).reshape(-1, len(classes)))

    def log_probs(self, columns: np.ndarray) -> np.ndarray:
        out, opened = np.zeros((len(columns), len(self.classes)), np.float32), np.arange(len(columns))
        for k in range(self.order, 0, -1):
            if not len(opened):
                break
            keys = _keys(columns[opened], k)
            for (sorted_keys, values), wanted in ((self.probs[k], keys), (self.backoff[k], keys - columns[opened, -1].astype(np.uint64))):
                at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
                hit = sorted_keys[at] == wanted
                if values is self.probs[k][1]:
                    out[opened[hit]] += values[at[hit]]
                    found = hit
                else:
                    hit &= ~found
                    out[opened[hit]] += values[at[hit]]
            opened = opened[~found]
        out[opened] += self.base
        return out

    def score(self, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each word the log-probability by class, and its number of characters with the end mark."""
        logs, sizes = np.zeros((len(vocab), len(self.classes))), np.zeros(len(vocab), np.int64)
        for word, rows, columns in _grams(vocab, self.order):
            _, first, which = np.unique(_keys(columns, self.order), return_index=True, return_inverse=True)
            values, own = self.log_probs(columns[first]), slice(word, word + len(rows))
            logs[own] += np.add.reduceat(values[which], np.cumsum(rows) - rows, axis=0, dtype=np.float64)
            sizes[own] += rows
        return logs, sizes

"""Whole texts as flat numpy arrays: tokens, hashes of tokens, code points. Work is done once per distinct word of a chunk."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of letters only, and words of letters, digits and underscores (patterns of what separates them).
NOT_LETTERS, NOT_WORD = r"[^\p{L}\p{M}]+", r"[^\p{L}\p{M}\p{N}_]+"
#: Bytes of text that a worker handles at once, and those where the work is per distinct word; one longer text is handled alone.
CHUNK_BYTES, WORD_CHUNK_BYTES = 1 << 20, 4 << 20
#: Characters that are in no word, in UTF-8: ASCII but letters, digits and the underscore; the ideographic space, comma and stop.
_BETWEEN = re.compile(rb"[\x00-/:-@\[-^`{-\x7f]|\xe3\x80[\x80-\x82]|\xef\xbc\x8c")
_P = np.uint64(0x9E3779B97F4A7C15)


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """The rows of all batches in tables of about that many bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(lengths), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + most - size, side="right")))
            held.append(batch.slice(at, stop - at))
            size += int(ends[stop - 1] - base)
            at = stop
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def pieces(column: pa.ChunkedArray, most: int = WORD_CHUNK_BYTES) -> Iterator[tuple[pa.ChunkedArray, np.ndarray]]:
    """(texts, the row of each): all texts of at most that many bytes, then pieces of the longer ones, one at a time.

    A text is cut between two words, so its pieces have its words; one without such a place is left whole.
    """
    lengths = np.concatenate([pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False) for c in column.chunks] or [np.zeros(0, int)])
    short = lengths <= most
    if short.all():
        yield column, np.arange(len(column))
        return
    yield column.filter(pa.array(short)), np.flatnonzero(short)
    for row in np.flatnonzero(~short).tolist():
        whole = column[row].as_buffer()
        at = 0
        while at < whole.size:
            cut = _BETWEEN.search(whole, at + most)
            stop = cut.end() if cut else whole.size
            yield pa.chunked_array([pa.array([whole.slice(at, stop - at).to_pybytes()], pa.large_binary()).cast(pa.large_string())]), np.array([row])
            at = stop


def flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


class Tokens:
    """vocab: distinct non-empty lower-case words; ids: the word at each token; offsets: first token of each text, and the end."""

    def __init__(self, column: pa.ChunkedArray, separator: str = NOT_LETTERS) -> None:
        texts = pc.utf8_lower(pc.fill_null(flat(column).cast(pa.large_string()), ""))
        words = pc.split_pattern(pc.replace_substring_regex(texts, separator, " "), " ")
        sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.dictionary_encode(words.flatten())
        ids, vocab = coded.indices.to_numpy(), coded.dictionary
        owner = np.repeat(np.arange(len(texts)), sizes)
        empty = pc.index(vocab, pa.scalar("", vocab.type)).as_py()
        if empty >= 0:
            full = ids != empty
            ids, owner = ids[full], owner[full]
            ids = np.where(ids > empty, ids - 1, ids)
            vocab = pa.concat_arrays([vocab.slice(0, empty), vocab.slice(empty + 1)])
        self.vocab, self.ids = vocab, ids
        self.offsets = np.searchsorted(owner, np.arange(len(texts) + 1))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum over each text's tokens of values, given for each word (a vector or a matrix)."""
        out = np.zeros((len(self.offsets) - 1, *values.shape[1:]))
        full = np.diff(self.offsets) > 0
        if full.any():
            out[full] = np.add.reduceat(values.astype(np.float64, copy=False)[self.ids], self.offsets[:-1][full], axis=0)
        return out


def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and the number of each word's."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), dtype="<u4"), lengths


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(codes: np.ndarray, lengths: np.ndarray, prefix: int | None = None) -> np.ndarray:
    """64-bit hash of each non-empty word, or of its first prefix characters."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    starts = np.cumsum(lengths) - lengths
    at = np.arange(len(codes)) - np.repeat(starts, lengths)
    power = np.cumprod(np.full(int(lengths.max()), _P, np.uint64))
    terms = (codes.astype(np.uint64) + np.uint64(1)) * power[at]
    if prefix is not None:
        terms[at >= prefix] = 0
    return mixed(np.add.reduceat(terms, starts))

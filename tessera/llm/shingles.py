"""Sets of five-word shingles of whole texts, as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tessera.llm.textarrays import NOT_WORD, Tokens, code_points, mixed, word_hashes

WORDS = 5
_STEP = 0xA24BAED4963EE407


def shingle_sets(column: pa.ChunkedArray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct shingles of each text. A text of fewer words is one shingle; one without words has none."""
    tokens = Tokens(column, NOT_WORD)
    hashed = word_hashes(*code_points(tokens.vocab))[tokens.ids] if len(tokens.vocab) else np.zeros(0, np.uint64)
    sizes = np.diff(tokens.offsets)
    runs = np.where(sizes > 0, np.maximum(sizes - words + 1, 1), 0)
    owner = np.repeat(np.arange(len(sizes)), runs)
    at = np.arange(len(owner)) + np.repeat(tokens.offsets[:-1] - (np.cumsum(runs) - runs), runs)
    h = np.zeros(len(owner), np.uint64)
    ends = tokens.offsets[1:][owner] if len(owner) else np.zeros(0, int)
    for j in range(words):
        inside = at + j < ends
        value = hashed[np.minimum(at + j, len(hashed) - 1)] if len(hashed) else h
        h = h * np.uint64(_STEP) + np.where(inside, value, np.uint64(j))
    h = mixed(h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[first], owner[first]
    return h, np.searchsorted(owner, np.arange(len(sizes) + 1))


def binaries(hashes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Each set as the bytes of its sorted hashes."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 8).astype(np.int64)), pa.py_buffer(hashes.tobytes())]).cast(pa.binary())

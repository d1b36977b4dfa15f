"""Embeddings and exact nearest neighbours by cosine."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

DIMS = 1024


def _code(gram: str, dims: int) -> int:
    """Component of a gram, plus dims if it counts negative."""
    h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "little")
    return h % dims + (0 if h >> 63 else dims)


_word, _trigram = lru_cache(maxsize=100_000)(_code), lru_cache(maxsize=100_000)(_code)
#: Words of at most so many characters of Latin-1 are taken together; others one at a time.
SHORT = 24


@lru_cache(maxsize=4)
def _table(dims: int) -> np.ndarray:
    """For three bytes: 1 more than the code of the trigram, or 0 if not yet known. Only the pages in use take memory."""
    return np.zeros(1 << 24, np.int32)


def _together(words: list[str], times: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, times) of the trigrams of distinct short words, each once for a word; a word of three characters has none but itself."""
    given = np.frombuffer(" ".join(words).encode("latin-1"), np.uint8).astype(np.int32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    whole = (given[:-2] != 32) & (given[1:-1] != 32) & (given[2:] != 32)
    keys = ((given[:-2] << 16) | (given[1:-1] << 8) | given[2:])[whole]
    owner = np.repeat(np.arange(len(words)), np.maximum(sizes - 2, 0))
    once = sizes[owner] > 3
    for d in range(1, int(sizes.max()) - 2):
        once[d:] &= (keys[d:] != keys[:-d]) | (owner[d:] != owner[:-d])
    keys, owner, table = keys[once], owner[once], _table(dims)
    codes = table[keys]
    if not codes.all():
        for k in set(keys[codes == 0].tolist()):
            table[k] = 1 + _code(k.to_bytes(3, "big").decode("latin-1"), dims)
        codes = table[keys]
    return codes - 1, times[owner]


def _alone(word: str, dims: int) -> list[int]:
    """Codes of a word's trigrams, each once."""
    return [_trigram(g, dims) for g in {word[i : i + 3] for i in range(len(word) - 2)} if g != word]


def _latin(text: str) -> bool:
    return text.isascii() or max(text) < "\u0100"


def hashed_embedding(text: str, dims: int = DIMS) -> np.ndarray:
    """Stand-in for a model: signed hashes of words and character trigrams, normalised."""
    counted = Counter(text.lower().split())
    if not counted:
        return np.zeros(dims, np.float64)
    words, times = list(counted), np.fromiter(counted.values(), np.float64, len(counted))
    codes, weights = [np.fromiter((_word(w, dims) if len(w) <= SHORT else _code(w, dims) for w in words), np.int64, len(words))], [times]
    short = [k for k, w in enumerate(words) if len(w) <= SHORT and _latin(w)]
    if short:
        found = _together([words[k] for k in short], times[short], dims)
        codes.append(found[0])
        weights.append(found[1])
    if len(short) < len(words):
        for k in set(range(len(words))).difference(short):
            codes.append(np.array(_alone(words[k], dims), np.int64))
            weights.append(np.full(len(codes[-1]), times[k]))
    signed = np.bincount(np.concatenate(codes), np.concatenate(weights), 2 * dims)
    out = signed[:dims] - signed[dims:]
    norm = math.sqrt(float(out @ out))
    return out / norm if norm else out


def embed_with(model=hashed_embedding):
    """Column function: text -> array of float, by a model that maps a text to a normalised vector."""

    @arrow_udf("array<float>")
    def embedded(text: pa.Array) -> pa.Array:
        found = [None if not t.is_valid else np.asarray(model(t.as_py()), np.float32) for t in text]
        ends = np.cumsum([0, *(0 if v is None else len(v) for v in found)], dtype=np.int32)
        flat = np.concatenate([np.zeros(0, np.float32), *(v for v in found if v is not None)])
        return pa.ListArray.from_arrays(ends, flat, mask=pa.array([v is None for v in found]))

    return embedded


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def knn(table: DataFrame, vector, k: int, where: Column | None = None, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(key, score): the k rows nearest to a vector. The filter comes before the distance, so k rows pass it."""
    rows = table if where is None else table.where(where)
    own, norm = F.col(embedding), math.sqrt(sum(float(x) ** 2 for x in vector))
    scored = rows.select(key, F.try_divide(dot(own, literal(vector)), F.sqrt(dot(own, own)) * F.lit(norm)).alias("score")).where("score is not null")
    return scored.orderBy(F.desc("score"), key).limit(k)


def knn_lsh(table: DataFrame, vector, k: int, key: str = "vec_id", embedding: str = "embedding", tables: int = 8, bucket: float = 0.5) -> DataFrame:
    """Approximate form of knn(): random projections of normalised vectors, whose Euclidean order is the cosine order."""
    rows = table.select(key, array_to_vector(F.transform(embedding, lambda x: x.cast("double"))).alias("__raw"))
    unit = Normalizer(inputCol="__raw", outputCol="__unit").transform(rows)
    model = BucketedRandomProjectionLSH(inputCol="__unit", outputCol="__hash", bucketLength=bucket, numHashTables=tables, seed=5).fit(unit)
    norm = math.sqrt(sum(float(x) ** 2 for x in vector)) or 1.0
    near = model.approxNearestNeighbors(unit, Vectors.dense([float(x) / norm for x in vector]), k, distCol="__d")
    return near.select(key, (1 - F.col("__d") * F.col("__d") / 2).alias("score"))

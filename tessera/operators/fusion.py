"""Reciprocal-rank fusion and reranking of short lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.operators.ranking import top

RRF_K = 60
MOST_RESULTS = 60


def shortlist(n: int, rerank: bool) -> int:
    """How many candidates each list gives for n results."""
    if not 1 <= n <= MOST_RESULTS:
        raise ValueError(f"results wanted: 1 to {MOST_RESULTS}, not {n}")
    return max(6 * n, 32) if rerank else n


def rrf(lists: list[DataFrame], key: str = "id", k: int = RRF_K) -> DataFrame:
    """(key, score) from ranked lists (key, rank from 1): the sum of 1 / (k + rank) over the lists that hold the key."""
    every = None
    for ranked in lists:
        part = ranked.select(key, (1.0 / (k + F.col("rank"))).alias("part"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(key).agg(F.sum("part").alias("score"))


def overlap(question: str, text: str) -> float:
    """Stand-in for a cross-encoder: share of the question's words that the text has."""
    asked = set(question.lower().split())
    return len(asked & set(text.lower().split())) / len(asked) if asked else 0.0


def rerank(candidates: DataFrame, question: str, n: int, scorer=overlap, key: str = "id", text: str = "text") -> DataFrame:
    """candidates (at most a short list) with rerank_score and rank: the n best by a scorer of (question, text)."""

    @pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: float(scorer(question, t or "")))

    rated = candidates.withColumn("rerank_score", scored(F.col(text)))
    best = top(rated.select(key, "rerank_score"), n, key, "rerank_score")
    return candidates.drop("rank", "score").join(F.broadcast(best), key)  # n rows

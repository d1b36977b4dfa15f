"""Hybrid search over chunks: BM25 and vectors, fused by rank, optionally reranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.operators import fusion, ranking
from tessera.operators.vectors import hashed_embedding, knn
from tessera.sources.staging import staged

# Fields of a result besides its id.
RESULT_FIELDS = ("text", "path", "start_line", "end_line", "title", "symbols", "lang", "mime", "file_lines", "kind", "chunk_id", "chunks")


def search(
    chunks: DataFrame, question: str, path_prefix: str = "", top_n: int = 10, symbols: list[str] | None = None, use_reranker: bool = True,
    model=hashed_embedding, scorer=fusion.overlap, postings: dict[str, DataFrame | ranking.StoredIndex] | None = None,
) -> DataFrame:
    """The top_n chunks for a question, with rank.

    The path filter comes before both retrievals, but BM25 statistics are the whole corpus's. postings: stored indexes or
    postings by analyser (key id), else the texts of chunks are scored without. Text and the other fields join in after the fusion.
    """
    short = fusion.shortlist(top_n, use_reranker)
    spark, keep = chunks.sparkSession, paths.has_prefix("path", path_prefix)
    within = chunks.where(keep).select("id") if paths.prefix_of(path_prefix) else None
    asked = {name: terms for name in ranking.BOOSTS if (terms := ranking.query_terms(spark, question, name))}
    if postings:
        of = lambda posted, terms: posted.bm25(terms, within) if isinstance(posted, ranking.StoredIndex) else ranking.bm25(posted, terms, key="id", within=within)
        scored = {name: of(postings[name], terms) for name, terms in asked.items()}
    else:
        scored = ranking.bm25_texts(chunks, asked, key="id", within=within) if asked else {}
    empty = spark.createDataFrame([], "id string, score double")
    text_scores = ranking.best_field(scored, key="id") if scored else empty
    if symbols:
        text_scores = ranking.with_symbols(text_scores, chunks.where(keep), symbols)
    by_text = ranking.top(text_scores, short, "id")
    near = knn(chunks, model(question), short, keep, "id")
    by_vector = ranking.top(near, short, "id")
    fused = ranking.top(fusion.rrf([by_text, by_vector]), short, "id")
    fields = chunks.select("id", *RESULT_FIELDS)
    found = fields.join(F.broadcast(fused), "id")  # a short list: 360 rows at most
    if use_reranker:
        found = staged(found)  # read twice
        return fusion.rerank(found, question, top_n, scorer).select("id", *RESULT_FIELDS, "rank")
    return found.where(F.col("rank") <= top_n).select("id", *RESULT_FIELDS, "rank")

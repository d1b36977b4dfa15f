"""Work that is not to be repeated as tables grow."""

import hashlib
import math

import numpy as np
from pyspark.util import PythonEvalType

from tessera.functions import blocks
from tessera.operators import ranking, vectors
from tessera.sources import files


def _plain_embedding(text, dims):
    out = np.zeros(dims, np.float64)
    for word in text.lower().split():
        for gram in {word, *(word[i : i + 3] for i in range(len(word) - 2))}:
            h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "little")
            out[h % dims] += 1.0 if h >> 63 else -1.0
    norm = math.sqrt(float(out @ out))
    return out / norm if norm else out


def test_embedding_hashes_a_gram_once(monkeypatch):
    calls, real = [], hashlib.blake2b
    texts = ["banana bananabanana aaaa abc ab a", "x" * 300 + "yz " + "über œuvre привет приветпривет ÿ\xa0b", "", " \n", *(f"the of {k} banana übung" for k in range(300))]
    monkeypatch.setattr(hashlib, "blake2b", lambda *a, **b: calls.append(1) or real(*a, **b))
    found = [vectors.hashed_embedding(t, 97) for t in texts]
    assert len(calls) < 800  # 5,000 if each gram of each text were hashed
    assert all((a == _plain_embedding(t, 97)).all() for a, t in zip(found, texts, strict=True))


def test_embeddings_of_a_batch(spark):
    rows = spark.createDataFrame([(1, "ab cd"), (2, None), (3, "")], "i int, t string").coalesce(1)
    got = {r["i"]: r["e"] for r in rows.select("i", vectors.embed_with()("t").alias("e")).collect()}
    assert got[2] is None and not any(got[3]) and np.allclose(got[1], vectors.hashed_embedding("ab cd"))
    one = rows.select("i", vectors.embed_with(lambda t: np.arange(len(t)))("t").alias("e")).collect()
    assert [r["e"] for r in one] == [[0, 1, 2, 3, 4], None, []]


def test_splitters_batches_are_small(spark):
    assert blocks.split_with().evalType == blocks.split_apart().evalType == PythonEvalType.SQL_BATCHED_UDF


def test_chunks_carry_no_whole_text(spark):
    rows = spark.createDataFrame([("a", "x\n\ny\n"), ("b", None), ("c", "")], "path string, text string").withColumn("blocks", blocks.split_with()("text"))
    parts = blocks.chunks(rows)
    assert [(r["path"], r["text"], r["chunks"]) for r in parts.orderBy("path", "chunk_id").collect()] == [("a", "x\n", 2), ("a", "y\n", 2), ("b", None, 1), ("c", "", 1)]
    made = [line for line in parts._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate " in line]
    assert len(made) == 1 and ", [path" not in made[0] and "posexplode" not in made[0]


def test_extractors_batches_are_small(spark):
    assert files.extracted().evalType == PythonEvalType.SQL_BATCHED_UDF


def test_texts_are_scored_without_postings(spark, monkeypatch):
    texts = [(1, "The nation's nations, v1.2 foo_bar foo"), (2, "национальный народ ёлка елками"), (3, None), (4, "the of"), (5, "possibility x9 9"), (5, "possible nation foo"), (6, "plain other words")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    asked = {n: ranking.query_terms(spark, "nations possible foo ёлки x9 absent", n) for n in ("simple", "code", "ru", "en")}
    want = {n: sorted(map(tuple, ranking.bm25(ranking.postings(docs, n), terms).collect())) for n, terms in asked.items()}
    monkeypatch.setattr(ranking, "postings", None)
    got = {n: sorted(map(tuple, part.collect())) for n, part in ranking.bm25_texts(docs, asked).items()}
    assert got == want and all(want.values())
    one = ranking.bm25_texts(docs, {"en": asked["en"]}, within=docs.where("doc_id = 1").select("doc_id"))["en"].collect()
    assert [tuple(r) for r in one] == [x for x in want["en"] if x[0] == 1]


def test_search_embeds_only_what_the_path_keeps(spark, sf_dir, monkeypatch):
    from tessera import queries

    monkeypatch.setattr(ranking, "postings", None)
    given, real = [], queries.search.search
    monkeypatch.setattr(queries.search, "search", lambda chunks, *a, **b: given.append(chunks) or real(chunks, *a, **b))
    assert queries.main_search(spark, sf_dir).count() == 10
    plan = given[0].where("path like 'src1%'").select("embedding")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "StartsWith" in plan[plan.index("ArrowEvalPython") :]

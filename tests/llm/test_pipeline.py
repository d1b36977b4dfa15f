"""The pipeline against a brute-force version on a small corpus with planted cases."""

import itertools
import random

import pytest

import corpus_pipeline
from tessera.llm.op06_mixing import targets


def _prose(rng, n):
    return ["".join(rng.choice("abdefhiklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, at = random.Random(31), tmp_path_factory.mktemp("corpus")
    bad = ["grakfoul", "grakvile", "grakmean", "grakrude"]
    items = [(k, " ".join(_prose(rng, 20))) for k in range(4)]
    docs, labels = [], []
    for i in range(700):
        words = _prose(rng, rng.randint(15, 90))
        toxic = i % 5 == 0
        for _ in range(4 if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(bad))
        if i % 29 == 3:
            words[5:5] = items[i % 4][1].split()
        docs.append([i, " ".join(words), "en", f"s{i % 7}"])
        labels.append((i, 1, int(toxic)))
    for i in range(700, 760):  # near and exact copies of clean documents
        words = docs[rng.choice([k for k in range(700) if k % 5])][1].split()
        if i % 2:
            words[rng.randrange(3)] = "changed"
        docs.append([i, " ".join(words), "en", f"s{i % 7}"])
    rows = [(*d, len(d[1])) for d in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), {d[0]: d for d in docs}, items


def _shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def _expected(docs, items):
    kept = {i: d for i, d in docs.items() if "grak" not in d[1]}
    sets, parent = {i: _shingles(d[1]) for i, d in kept.items()}, {i: i for i in kept}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(kept, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    single = {i for i in kept if root(i) == i}
    leaks = {i for i in single for _, t in items if len(sets[i] & _shingles(t)) >= 0.8 * len(_shingles(t))}
    return set(kept), single, single - leaks


def test_stages(spark, corpus):
    sf_dir, docs, items = corpus
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = frame.columns
    wanted = _expected(docs, items)
    for (name, function), want in zip(corpus_pipeline.STAGES[:3], wanted, strict=False):
        out = function(spark, frame, sf_dir)
        assert out.columns == columns, name
        assert {r["doc_id"] for r in out.select("doc_id").collect()} == want, name
        frame = corpus_pipeline.stage(out, "test")
    assert len(docs) > len(wanted[0]) > len(wanted[1]) > len(wanted[2])


def test_run(spark, corpus):
    sf_dir, docs, items = corpus
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    left = _expected(docs, items)[2]
    words = {i: len(docs[i][1].split()) for i in left}
    sizes = {}
    for i in left:
        sizes[docs[i][3]] = sizes.get(docs[i][3], 0) + words[i]
    taken = {}
    for r in rows:
        taken[r["source"]] = taken.get(r["source"], 0) + words[r["doc_id"]]
    for source, target in targets(list(sizes.items())):
        assert abs(taken[source] - target) <= 1
    by, total = {}, sum(r["size"] for r in rows)
    for r in rows:
        assert r["size"] == len(docs[r["doc_id"]][1].encode()) + 16
        by.setdefault(r["shard"], []).append(r)
    largest = max(r["size"] for r in rows)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        # copies of a row are one lump: at most three of them
        assert abs(sum(r["size"] for r in own) - total / 40) <= 3 * largest


def test_rows_without_ids_and_repeated_rows(spark, corpus):
    sf_dir = corpus[0]
    frame = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, "a b c d e f g", "en", "s", 13), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.drop_near_copies(spark, frame, sf_dir).collect()) == ["1", "None"]
    assert corpus_pipeline.drop_leaks(spark, frame, sf_dir).count() == 4
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, frame.where("false"), sf_dir).count() == 0

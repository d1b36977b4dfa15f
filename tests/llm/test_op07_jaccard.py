import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import components as joins
from tessera.llm import op07_jaccard_join as op
from tessera.llm.components import components
from tessera.llm.shared import stage
from tessera.llm.shingles import shingle_sets


def _set(text):
    w = text.lower().split() if text else []
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _brute(docs, threshold=0.8):
    """(class, copy, links) of each document."""
    classes = {}
    for i, t in docs:
        classes.setdefault(_set(t) or ("none", i), []).append(i)
    rep = {k: min(v) for k, v in classes.items()}
    links, parent = {r: 0 for r in rep.values()}, {r: r for r in rep.values()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    real = [k for k in rep if isinstance(k, frozenset)]
    for a, b in itertools.combinations(real, 2):
        if len(a & b) >= threshold * len(a | b):
            for x in (a, b):
                links[rep[x]] += 1
            x, y = sorted((root(rep[a]), root(rep[b])))
            parent[y] = x
    return {i: (root(rep[k]), rep[k], links[rep[k]]) for k, v in classes.items() for i in v}


def _corpus(rng, families=12):
    docs = []
    for _ in range(families):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([4, 12, 60, 200]))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(5000)}"
            docs.append((len(docs), " ".join(copy)))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("block", [256, 4])
def test_equals_brute_force(make, monkeypatch, block):
    monkeypatch.setattr(op, "BLOCK", block)
    docs = _corpus(random.Random(11))
    got = {r["doc_id"]: (r["class_id"], r["copy_id"], r["n_links"]) for r in op.jaccard_join(make(*docs)).collect()}
    assert got == _brute(docs)


def test_large_group_of_near_copies(make, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 16)
    rng = random.Random(2)
    base = [f"w{k}" for k in range(80)]
    docs = []
    for i in range(90):
        copy = list(base)
        copy[rng.randrange(80)] = f"n{i}"
        docs.append((i, " ".join(copy)))
    docs += [(100 + i, " ".join(base)) for i in range(40)]
    got = {r["doc_id"]: (r["class_id"], r["copy_id"], r["n_links"]) for r in op.jaccard_join(make(*docs)).collect()}
    assert got == _brute(docs)


def test_edges(make):
    docs = [(1, None), (2, ""), (3, "..."), (4, "one two"), (5, "One, two!"), (6, "word " * 60_000), (7, "word word word word word"), (4, "one two")]
    frame = make(*docs, (None, "one two"), (None, "lone text of its own here")).withColumn("class_id", F.lit("old"))
    rows = op.jaccard_join(frame).collect()
    assert len(rows) == 10
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows if r["doc_id"] is not None}
    assert got == {1: (1, 0), 2: (2, 0), 3: (3, 0), 4: (4, 0), 5: (4, 0), 6: (6, 0), 7: (6, 0)}
    assert sorted(str(r["class_id"]) for r in rows if r["doc_id"] is None) == ["4", "None"]
    assert op.jaccard_join(frame.where("false")).count() == 0


def test_prefixes_are_shortened_until_the_recall_is_met():
    rng, threshold, recall = np.random.default_rng(6), 0.8, 0.999
    floor = op.floor_for(threshold, recall)
    kinds = op.DEPTH - floor + 1
    below = np.sort(rng.integers(1, 50, (40, op.TREES, kinds)), axis=2)[:, :, ::-1].copy()
    below[0] = 1  # alone everywhere: shortened for nothing
    below[1, :, :] = np.arange(kinds, 0, -1)  # every step costs the same
    below[2, 3, :-1] = 10_000  # a crowded trie
    got = op.depths(below, threshold, recall)
    assert got.min() >= floor and got.max() <= op.DEPTH and (got[0] == floor).all()
    miss = (1 - threshold**got).prod(1)
    assert (miss <= 1 - recall).all() and got[2, 3] == op.DEPTH
    assert (miss[1] > (1 - recall) * 0.8) and (got[1] > floor).any()  # no further than needed
    assert op.floor_for(0.5, 0.999) < op.FLOOR


def test_repeated_ids_with_other_texts(make):
    rng = random.Random(8)
    a, b = ([f"{c}{rng.randrange(9000)}" for _ in range(60)] for c in "ab")
    changed = lambda w: " ".join(["new", *w[1:]])
    rows = op.jaccard_join(make((1, " ".join(a)), (1, " ".join(b)), (5, changed(a)), (6, changed(b)))).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 1, 1, 1), (1, 1, 1, 1), (5, 1, 5, 1), (6, 1, 6, 1)]


def test_sizes_far_apart_are_not_compared(make):
    words = [f"w{k}" for k in range(400)]
    docs = [(n, " ".join(words[:n])) for n in range(5, 400, 7)]  # a chain of prefixes over many levels of size
    got = {r["doc_id"]: (r["class_id"], r["copy_id"], r["n_links"]) for r in op.jaccard_join(make(*docs)).collect()}
    assert got == _brute(docs)


def test_overlaps_in_parts(monkeypatch):
    monkeypatch.setattr(op, "COLUMNS", 7)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 25).astype(np.uint64)) for _ in range(9)]
    got = op.overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(9) for j in range(9) if i != j)
    assert (op.overlaps(sets[:4], sets[4:]) == got[:4, 4:]).all()


def test_shingle_sets():
    column = pa.chunked_array([pa.array(["a b c d e f", "a b c d e", "A, b c d e f!", "a b", None, "a b c d e a b c d e"], pa.string())])
    hashes, offsets = shingle_sets(column)
    sets = [set(hashes[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert [len(s) for s in sets] == [2, 1, 2, 1, 0, 5] and sets[0] == sets[2] and sets[1] < sets[0] and not sets[3] & sets[0]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 230)] + [(500, 500)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("few", [0, 200_000])
def test_components_of_few_links_need_no_rounds(spark, monkeypatch, few):
    names = []
    monkeypatch.setattr(joins, "FEW", few, raising=False)
    monkeypatch.setattr(joins, "stage", lambda df, name: names.append(name) or stage(df, name))
    chain = [(i + 1, i) for i in range(100, 140)] + [(7, k) for k in range(900, 930)] + [(-3, 900), (5, 5), (139, 100)]
    rows = joins.components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in rows} == {i: 100 for i in range(100, 141)} | {k: -3 for k in (-3, 7, *range(900, 930))}
    assert len(rows) == 41 + 32 and ("stars" in names) is (few == 0)


def test_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert {r["doc_id"] for r in op.op7_jaccard_join(spark, sf_dir).collect()} == {i for i, _ in docs}

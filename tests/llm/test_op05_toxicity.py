import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import op05_toxicity as op


def _brute(scores):
    """Maximal segments by their definition: every proper part scores less, and none that contains it has that property."""
    sums = [0.0, *itertools.accumulate(scores)]
    value = lambda a, b: sums[b] - sums[a]
    n = len(scores)
    good = [(a, b) for a in range(n) for b in range(a + 1, n + 1) if all(value(c, d) < value(a, b) - 1e-12 for c in range(a, b) for d in range(c + 1, b + 1) if (c, d) != (a, b)) and value(a, b) > 0]
    return [(a, b) for a, b in good if not any((c, d) != (a, b) and c <= a and b <= d for c, d in good)]


@pytest.mark.parametrize("seed", range(12))
def test_segments_equal_brute_force(seed):
    rng = random.Random(seed)
    scores = np.array([rng.choice([-2.5, -1.0, -0.7, 1.3, 2.1, 0.4]) + rng.random() / 100 for _ in range(24)])
    assert [(a, b) for a, b, _ in op.maximal_segments(scores)] == _brute(scores.tolist())


def test_segments_of_nothing():
    assert op.maximal_segments(np.zeros(0)) == [] and op.maximal_segments(np.array([-1.0, -2.0])) == []


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    calm = ["kala", "miro", "senta", "bolu", "vari", "deno", "lumi", "tarok", "pesi", "onda"]
    bad = ["grakfoul", "grakvile", "grakmean", "grakrude"]
    rows = []
    for i in range(800):
        words = [rng.choice(calm) + rng.choice(calm) for _ in range(40)]
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randint(0, 40), rng.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


@pytest.fixture(scope="module")
def model(labelled):
    return op.fit(labelled.where("doc_id < 600"))


def test_held_out_documents(labelled, model):
    rows = op.score(labelled.where("doc_id >= 600"), model).collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.98 * len(rows)
    assert all("grak" in p["words"] for r in rows if r["predicted"] for p in r["passages"])


def test_calibration_does_not_depend_on_the_sampled_share(labelled):
    """Fewer sampled clean documents weigh more: the threshold stays between the classes."""
    model = op.fit(labelled.where("doc_id < 600"), per_class=120)
    rows = op.score(labelled, model).collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.97 * len(rows)


def test_edges(make, model):
    docs = make((1, None), (2, ""), (3, "!!"), (4, "GRAKFOUL grakvile"), (4, "GRAKFOUL grakvile"), (None, "kalamiro"), (5, "kalamiro " * 60_000)).withColumn("predicted", F.lit("old"))
    out = op.score(docs, model)
    rows = out.collect()
    assert len(rows) == 7 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert [r["predicted"] for r in rows if r["doc_id"] == 4] == [1, 1] and sum(r["predicted"] for r in rows) == 2
    assert out.columns == [*[c for c in docs.columns if c != "predicted"], "score", "predicted", "passages"]
    assert op.score(docs.where("false"), model).count() == 0


def test_without_labels(make, labelled):
    for none in (labelled.where("false"), labelled.where("toxic = 0").limit(20)):
        assert op.score(make((1, "some words")), op.fit(none)).first()["score"] <= 0.5


def test_query(spark, sf_dir):
    rows = op.op5_toxicity(spark, sf_dir).collect()
    assert len(rows) == 200 and all(0 <= r["score"] <= 1 for r in rows)

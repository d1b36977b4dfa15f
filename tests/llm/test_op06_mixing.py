import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import op06_mixing as op


def test_targets():
    assert op.targets([("b", 100), ("a", 100), (None, 100)]) == [("a", 50.0), ("b", 100.0), (None, 150.0)]
    # b can give 30 at most; what is over goes to the others by weight
    assert op.targets([("a", 300), ("b", 10), ("c", 290)]) == [("a", 142.5), ("b", 30.0), ("c", 427.5)]
    assert op.targets([]) == [] and op.targets([("a", 0)]) == [("a", 0.0)]


@pytest.mark.parametrize("seed", range(8))
def test_fit_is_as_near_as_brute_force(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 60): rng.randint(1, 4) for _ in range(6)}
    budget = rng.randint(0, sum(n * c for n, c in counts.items()))
    reach = {0}
    for n, c in counts.items():
        reach = {w + n * k for w in reach for k in range(c + 1)}
    take = op.fit(budget, counts)
    got = sum(n * k for n, k in take.items())
    assert all(0 <= take[n] <= c for n, c in counts.items())
    assert abs(got - budget) == min(abs(w - budget) for w in reach)


def test_large_budget_is_exact():
    rng = random.Random(1)
    counts = {n: rng.randint(1, 9) for n in range(3, 4_000)}
    budget = sum(n * c for n, c in counts.items()) * 2 // 5 + 1
    assert sum(n * k for n, k in op.fit(budget, counts).items()) == budget


def test_mix(make):
    rng = random.Random(2)
    docs = make(*[(i, "w " * rng.randint(1, 40), "en", rng.choice(["a", "b", None])) for i in range(600)], (600, None), (601, ""), (None, "x y", "en", "a"))
    out = op.mix(docs.withColumn("times", F.lit("old")))
    rows = out.collect()
    assert len(rows) == 603 and out.columns[:5] == docs.columns
    for source in ("a", "b", None, "s"):
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["size"] * r["times"] for r in own) - own[0]["target"]) <= 1
        assert own[0]["source_size"] == sum(r["size"] for r in own)
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0d]+", r["text"] or "")) and 0 <= r["times"] <= 3 for r in rows)
    again = {(r["doc_id"], r["times"]) for r in op.mix(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["times"]) for r in rows}


def test_hot_length_is_ranked_in_parts(make, monkeypatch):
    monkeypatch.setattr(op, "ROWS_PER_TASK", 25)
    docs = make(*[(i, "one two three", "en", "abc"[i % 3]) for i in range(900)])
    rows = op.mix(docs).collect()
    assert sorted(sum(3 * r["times"] for r in rows if r["source"] == s) for s in "abc") == [450, 900, 1350]


def test_empty(make):
    assert op.mix(make().where("false")).count() == 0
    rows = op.mix(make((1, None), (2, ""))).collect()
    assert [(r["times"], r["target"]) for r in rows] == [(0, 0.0)] * 2


def test_query(spark, sf_dir):
    rows = op.op6_mixing(spark, sf_dir).collect()
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(sum(r["size"] for r in rows))
    for own in by.values():
        # the nearest that whole documents can come: a subset of a source's few documents, besides all of them some times
        reach, target = {0}, own[0]["target"]
        for r in own:
            reach |= {w + r["size"] for w in reach}
        whole = own[0]["source_size"] * min(3, int(target // own[0]["source_size"]))
        off = abs(sum(r["taken"] for r in own) - round(target))
        assert off == min(abs(whole + w - round(target)) for w in reach)
        assert all(r["taken"] <= 3 * r["size"] for r in own)

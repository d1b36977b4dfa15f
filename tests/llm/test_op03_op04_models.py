import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tessera.llm import charlm
from tessera.llm import op03_language as lid
from tessera.llm import op04_lm_scoring as lm
from tessera.llm.charlm import CharLM, count_grams
from tessera.llm.shared import held_out
from tessera.llm.textarrays import NOT_LETTERS, Tokens, code_points, pieces, word_hashes


class Brute:
    """Interpolated Kneser-Ney over the characters of words, written plainly."""

    def __init__(self, words, order):
        self.order, top = order, Counter()
        for w, k in words.items():
            s = "\x02" * (order - 1) + w + "\x03"
            for i in range(len(s) - order + 1):
                top[s[i : i + order]] += k
        self.levels = {order: top}
        for n in range(order - 1, 0, -1):
            self.levels[n] = Counter(g[1:] for g in self.levels[n + 1])
        self.d = {}
        for n, c in self.levels.items():
            one, two = (sum(v == k for v in c.values()) for k in (1, 2))
            self.d[n] = min(0.95, max(0.1, one / max(one + 2 * two, 1))) if one else 0.5

    def p(self, gram, alphabet):
        if not gram:
            return 1 / (alphabet + 1)
        n = len(gram)
        inside = {g: v for g, v in self.levels[n].items() if g[:-1] == gram[:-1]}
        below = self.p(gram[1:], alphabet)
        if not inside:
            return below
        total = sum(inside.values())
        return max(inside.get(gram, 0) - self.d[n], 0) / total + self.d[n] * len(inside) / total * below


def test_model_equals_brute_force(spark):
    rng = random.Random(4)
    texts = {c: " ".join("".join(rng.choice(a) for _ in range(rng.randint(1, 5))) for _ in range(40)) for c, a in (("x", "abcd"), ("y", "bcde"))}
    docs = spark.createDataFrame([(c, t) for c, t in texts.items()], "class string, text string")
    model = CharLM.from_counts(count_grams(docs, NOT_LETTERS, 3), ["x", "y"], 3)
    alphabet = len(set("".join(texts.values()).replace(" ", ""))) + 1
    probe = ["abc", "e", "zz", "bcdbcd"]
    logs, sizes = model.score(pa.array(probe, pa.large_string()))
    assert sizes.tolist() == [len(w) + 1 for w in probe]
    for j, c in enumerate(("x", "y")):
        brute = Brute(Counter(texts[c].split()), 3)
        for i, w in enumerate(probe):
            s = "\x02\x02" + w + "\x03"
            want = sum(math.log(brute.p(s[k : k + 3], alphabet)) for k in range(len(s) - 2))
            assert logs[i, j] == pytest.approx(want, rel=1e-4)


def test_tokens_keep_the_rows_apart():
    column = pa.chunked_array([pa.array(["Ab, ab cd", None, "", "123", "É x"], pa.string())])
    tokens = Tokens(column)
    texts = [[tokens.vocab[int(i)].as_py() for i in tokens.ids[a:b]] for a, b in zip(tokens.offsets[:-1], tokens.offsets[1:], strict=True)]
    assert texts == [["ab", "ab", "cd"], [], [], [], ["é", "x"]]
    assert tokens.sums(np.ones(len(tokens.vocab))).tolist() == [3, 0, 0, 0, 2]
    hashes = word_hashes(*code_points(tokens.vocab))
    assert len(set(hashes.tolist())) == len(tokens.vocab)


def _languages(make, n=60):
    rng = random.Random(9)
    pools = {"aa": ["bala", "mano", "kolo", "sabi"], "bb": ["wrxt", "pqst", "zzyx", "vrum"]}
    return make(*[(i, " ".join(rng.choice(pools[c]) for _ in range(30)), c if i % 10 else None) for i in range(n) for c in ("aa" if i % 2 else "bb",)])


def test_language(make):
    docs = _languages(make)
    known = lid.learn(docs.where(~held_out()))
    odd = make((1, None), (2, ""), (3, "12 !?"), (4, "Bala MANO"), (4, "Bala MANO"), (None, "wrxt"), (5, "bala " * 50_000))
    rows = [r.asDict() for r in lid.identify(odd.withColumn("score", F.lit("x")), known).collect()]
    assert [r["lang_pred"] for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"]))] == ["und", "und", "und", "aa", "aa", "aa", "bb"]
    assert all(0 <= r["score"] <= 1 for r in rows) and all(r["rejected"] for r in rows if r["lang_pred"] == "und")
    assert lid.identify(docs.where("false"), known).count() == 0
    strange = lid.identify(make((1, "ñññ ößæ " * 20)), known).first()
    assert strange["rejected"] and strange["lang_pred"] in ("aa", "bb")


def test_nothing_to_learn(make):
    docs = make((1, "abc", None))
    assert lid.learn(docs) is None and lid.learn(docs.where("false")) is None
    assert lid.identify(docs, None).first()["lang_pred"] == "und"


def test_language_query(spark, sf_dir):
    out = lid.op3_language(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = out.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    apart = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in apart) / len(apart) > 0.98


def _scores(docs):
    """n_tokens, ce_target, ce_background, ce_corpus and score of each (text, in_target), from counts of the other rows."""
    tokens = [[w.lower() for w in re.findall(r"\w+", t or "")] for t, _ in docs]
    tokens = [w + ["\n"] if w else [] for w in tokens]
    vocabulary = {w for own in tokens for w in own}
    sizes = [sum(len(w) for w, (_, x) in zip(tokens, docs, strict=True) if bool(x) is side) for side in (True, False)]
    scale = sizes[0] / sizes[1]
    out = []
    for i, own in enumerate(tokens):
        ces = []
        for sides, worth in (((True,), 1.0), ((False,), scale), ((True, False), 1.0)):
            single, double = Counter(), Counter()
            for j, other in enumerate(tokens):
                if j != i and bool(docs[j][1]) in sides:
                    single.update(other)
                    double.update(zip(["\n", *other[:-1]], other, strict=True)) if other else None
            total = 0.0
            for v, w in zip(["\n", *own[:-1]], own, strict=True) if own else ():
                alone = (worth * single[w] + lm.ADDED) / (worth * sum(single.values()) + lm.ADDED * len(vocabulary))
                weight = lm.WEIGHT * worth * single[v] / (worth * single[v] + lm.HALF)
                total -= math.log(weight * double[v, w] / max(single[v], 1) + (1 - weight) * alone)
            ces.append(total / max(len(own), 1))
        out.append((len(own), *ces, ces[0] - ces[1]))
    return out


@pytest.mark.parametrize(("chunk", "bucket"), [(4 << 20, 16 << 20), (300, 400)])
def test_lm_scores_equal_brute_force(make, monkeypatch, chunk, bucket):
    monkeypatch.setattr(lm, "WORD_CHUNK_BYTES", chunk)
    monkeypatch.setattr(lm, "BUCKET_BYTES", bucket)
    rng = random.Random(14)
    pool = [f"w{k}" for k in range(40)]
    docs = [(" ".join(rng.choice(pool[: 20 if k % 3 else 40]) for _ in range(rng.randint(0, 25))), k % 3 == 0) for k in range(60)]
    docs += [(None, True), ("", False), ("...", None), (docs[3][0], True), (docs[4][0], None), ("Ünï w1_2 w1", None)]
    frame = make(*[(k if k % 7 else None, t) for k, (t, _) in enumerate(docs)])
    flags = {k: x for k, (_, x) in enumerate(docs)}
    marked = frame.select("*", F.lit("clash").alias("chunk"), F.lit("clash").alias("score"))
    by_text = F.create_map(*[F.lit(v) for t, x in docs if x and t for v in (t, True)])
    rows = lm.score_against_target(marked.withColumn("in_target", by_text[F.coalesce("text", F.lit("none"))])).collect()
    target = {t for t, x in docs if x and t}
    want = sorted(_scores([(t, t in target) for t, _ in docs]))
    got = sorted(tuple(r)[1:] for r in rows)
    assert len(got) == len(want) == len(flags) and sum(r["doc_id"] is None for r in rows) == len([k for k in flags if k % 7 == 0])
    for x, y in zip(got, want, strict=True):
        assert x == pytest.approx(y, rel=1e-9, abs=1e-9)


def test_lm_scoring_edges(make):
    docs = _languages(make).withColumn("in_target", F.col("lang") == "aa")
    long = make((900, "bala " * 60_000), (901, "x" * 100_000)).withColumn("in_target", F.lit(None).cast("boolean"))
    rows = {r["doc_id"]: r for r in lm.score_against_target(docs.unionByName(long)).collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert all((r["score"] < 0) == (lang[i] == "aa") for i, r in rows.items() if i < 900 and lang[i]) and rows[900]["n_tokens"] == 60_001
    assert lm.score_against_target(docs.where("false")).count() == 0
    alone = lm.score_against_target(make((1, "one two")).withColumn("in_target", F.lit(True))).first()
    assert alone["n_tokens"] == 3 and math.isfinite(alone["score"])


def test_copies_are_known_to_the_corpus(make):
    rng = random.Random(3)
    pool = [f"w{k}" for k in range(3_000)]
    texts = [" ".join(rng.choice(pool) for _ in range(80)) for _ in range(200)]
    docs = make(*enumerate(texts + texts[:20])).withColumn("in_target", F.col("doc_id") % 2 == 0)
    ce = {r["doc_id"]: r["ce_corpus"] for r in lm.score_against_target(docs).collect()}
    twice = [v for i, v in ce.items() if i < 20 or i >= 200]
    assert max(twice) < min(v for i, v in ce.items() if 20 <= i < 200)


def test_lm_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = lm.op4_lm_scoring(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    means = {r["quality"]: r["m"] for r in rows.join(labels, "doc_id").groupBy("quality").agg(F.avg("score").alias("m")).collect()}
    assert means[1] < means[0] and rows.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_long_texts_are_scored_in_parts(make, monkeypatch):
    docs = _languages(make)
    known = lid.learn(docs.select("doc_id", "text", "lang"))
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh ,.。é7_") for _ in range(4000)), None, "", "".join(rng.choice("abc") for _ in range(3000)), "ab cd"]
    column = pa.chunked_array([pa.array(texts, pa.string())])
    words = [pc.value_counts(t.vocab.take(pa.array(t.ids))).to_pylist() for t in [Tokens(column)]]
    whole = known.predict(column)
    monkeypatch.setattr(charlm, "ROWS", 50)
    monkeypatch.setattr(lid, "pieces", lambda c: pieces(c, 64))
    parts = known.predict(column)
    assert whole[0] == parts[0] and whole[3].tolist() == parts[3].tolist()
    assert np.allclose(whole[1], parts[1], rtol=1e-9) and np.allclose(whole[2], parts[2], rtol=1e-9)
    cut = [(t, row) for some, rows in pieces(column, 64) for t, row in zip(some.to_pylist(), rows.tolist(), strict=True)]
    assert all("".join(t or "" for t, row in cut if row == i) == (text or "") for i, text in enumerate(texts)) and len(cut) > 50
    counted = Counter(t.vocab[int(i)].as_py() for some, _ in pieces(column, 64) for t in [Tokens(some)] for i in t.ids)
    assert counted == Counter({x["values"]: x["counts"] for x in words[0]})


def test_memory_for_a_long_word_is_bounded(make):
    model = lid.learn(_languages(make).select("doc_id", "text", "lang")).model

    def peak(n):
        word = pa.array(["abcdefgh" * (n // 8)], pa.large_string())
        tracemalloc.start()
        try:
            model.score(word)
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    assert peak(1_200_000) - peak(400_000) < 40 * 800_000

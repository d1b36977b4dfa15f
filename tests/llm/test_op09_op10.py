import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import op09_neighbours as ann
from tessera.llm import op10_substrings as cdc

SCHEMA = "vec_id long, embedding array<float>, label int"


def _exact(vectors, query, k=20):
    q = np.array(vectors[query], np.float32).astype(float)
    scored = sorted((-float(np.array(v, np.float32).astype(float) @ q), i) for i, v in vectors.items() if i != query)
    return [i for _, i in scored[:k]]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    vectors = {i: (centres[i % 20] * rng.uniform(0.5, 2) + rng.normal(size=16)).tolist() for i in range(3_000)}
    rows = ann.neighbours(spark.createDataFrame([(i, v, 0) for i, v in vectors.items()], SCHEMA), F.col("vec_id") % 20 == 0).collect()
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], []).append(r)
    recalls = []
    for q, own in found.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert [r["score"] for r in own] == sorted((r["score"] for r in own), reverse=True)
        a, b = (np.array(vectors[x], np.float32).astype(float) for x in (q, own[0]["vec_id"]))
        assert own[0]["score"] == pytest.approx(float(a @ b), rel=1e-12)
        recalls.append(len({r["vec_id"] for r in own} & set(_exact(vectors, q))) / 20)
    assert len(found) == 150 and np.mean(recalls) >= 0.9


def test_few_candidates_ties_and_unusable_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 0), (1, [2.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 1.0], 0), (4, None, 0), (5, [0.0, 0.0], 0), (6, [nan, 1.0], 0), (7, [None, 1.0], 0), (8, [float("inf"), 0.0], 0), (9, [1.0, 2.0, 3.0], 0), (None, [9.0, 9.0], 0), (20, [1.0, 0.0], 0), (10, [], 0)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("clash")).withColumn("row", F.lit("clash"))
    got = [tuple(r) for r in ann.neighbours(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, 1.0), (0, 4, 3, 0.0), (20, 1, 1, 2.0), (20, 2, 2, 2.0), (20, 3, 0, 1.0), (20, 4, 3, 0.0)]
    assert ann.neighbours(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.neighbours(table.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


def _brute(rows, k=20):
    """(query_id, rank, vec_id, score) of all rows as candidates but the query's own, by sums in the components' order."""
    out = []
    for i, (q, u) in enumerate(rows):
        if q % 20 == 0:
            scored = []
            for j, (v, w) in enumerate(rows):
                if i != j and len(u) == len(w):
                    total = 0.0
                    for x, y in zip(u, w, strict=True):
                        total += x * y
                    scored.append((-total, v))
            out += [(q, r, v, -s) for r, (s, v) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_mixed_dimensions_and_repeated_ids_equal_brute_force(spark, kind):
    rng = np.random.default_rng(12)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=(2, 5, 8)[i % 3])]) for i in range(90)]
    rows += [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in (0, 1, 20)]  # other vectors of the same ids
    rows += [(0, rows[0][1]), (7, rows[7][1])]
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = sorted(tuple(r) for r in ann.neighbours(table, F.col("vec_id") % 20 == 0).collect())
    assert got == _brute(rows)


def test_cells_stay_small_and_recall_holds_beyond_the_sample(spark, monkeypatch):
    for name, value in (("SAMPLE", 300), ("LEAF", 32), ("MOST", 64), ("LEAST", 16), ("TRIALS", 40)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 12))
    vectors = {i: (centres[i % 30] + 0.4 * rng.normal(size=12)).tolist() for i in range(2_500)}
    table = spark.createDataFrame([(i, v, 0) for i, v in vectors.items()], SCHEMA)
    seen = []
    monkeypatch.setattr(ann, "calibrated", lambda index, *a, own=ann.calibrated: (seen.append(index), own(index, *a))[1])
    found = {}
    for r in ann.neighbours(table, F.col("vec_id") % 20 == 0, trees=4).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    sizes = [r["count"] for r in seen[0].members.groupBy("cell").count().collect()]
    assert seen[0].levels and max(sizes) <= 64 and sum(sizes) == 4 * 2_500
    assert len(found) == 125 and np.mean([len(v & set(_exact(vectors, q))) / 20 for q, v in found.items()]) >= 0.9


def test_a_third_of_the_rows_is_one_vector(spark):
    rng = np.random.default_rng(8)
    vectors = {i: [1.0, 1.0, 0.0, 0.0] if i % 3 == 0 else rng.normal(size=4).tolist() for i in range(600)}
    rows = ann.neighbours(spark.createDataFrame([(i, v, 0) for i, v in vectors.items()], SCHEMA), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in rows] == _exact(vectors, 0)


def test_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    table = spark.createDataFrame([(i, rng.normal(size=8).tolist(), 0) for i in range(500)], SCHEMA)
    whole = sorted(map(tuple, ann.neighbours(table, F.col("vec_id") % 20 == 0).collect()))
    monkeypatch.setattr(ann, "BLOCK", 10)
    assert sorted(map(tuple, ann.neighbours(table, F.col("vec_id") % 20 == 0).collect())) == whole


def test_other_cells_give_only_rows_that_can_be_nearest(spark, monkeypatch):
    for name, value in (("SAMPLE", 300), ("LEAF", 32), ("MOST", 64), ("LEAST", 16), ("TRIALS", 40)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(6)
    vectors = {i: rng.normal(size=10).round(1).tolist() for i in range(1_500)} | {i: [1.0] * 10 for i in range(1_500, 1_560)}
    vectors |= {3_000: [1.0, 2.0], 3_020: [2.0, 1.0]}  # fewer candidates than neighbours
    table = spark.createDataFrame([(i, v, 0) for i, v in vectors.items()], SCHEMA)
    made = []
    monkeypatch.setattr(ann, "_compared", lambda *a, own=ann._compared: (rows := own(*a), made.append(rows.count()))[0])
    got = {}
    for first in (4, 10**6):
        monkeypatch.setattr(ann, "FIRST", first)
        got[first] = sorted(map(tuple, ann.neighbours(table, F.col("vec_id") % 20 == 0, trees=4).collect()))
    few, later, whole = made
    assert got[4] == got[10**6] and len(got[4]) == 78 * 20 + 2 and few + later < whole / 2


def test_least_scores_leave_out_nothing_that_has_them():
    vectors = np.array([[1.0, 0.0], [0.5, 0.0], [0.5, 0.0], [0.1, 0.0]])
    q, v, score = ann._top_exact(np.array([[1.0, 0.0]] * 3), np.array([0.5, -np.inf, 2.0]), vectors, np.array([0, 2, 1, 3]), 3)
    assert list(zip(q.tolist(), v.tolist(), score.tolist(), strict=True)) == [(0, 0, 1.0), (0, 2, 0.5), (0, 1, 0.5), (1, 0, 1.0), (1, 2, 0.5), (1, 1, 0.5)]


def test_neighbours_query(spark, sf_dir):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    found = {}
    for r in ann.op9_neighbours(spark, sf_dir).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(found) == {i for i in vectors if i % 20 == 0}
    assert np.mean([len(v & set(_exact(vectors, q))) / 20 for q, v in found.items()]) >= 0.9


def _prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_repeats_are_found_and_resist_insertions(make):
    rng = random.Random(21)
    passages = [_prose(rng, 55) for _ in range(30)]
    docs = [(i, _prose(rng, 200)) for i in range(60)]
    for k, p in enumerate(passages):  # in two documents, at odd places
        for i in (2 * k, (2 * k + 31) % 60):
            text = docs[i][1]
            at = rng.randrange(len(text))
            docs[i] = (i, f"{text[:at]} {p} {text[at:]}")
    clean = [(1_000 + i, _prose(rng, 200)) for i in range(60)]
    spans = cdc.repeated_spans(make(*docs, *clean)).collect()
    assert {r["doc_id"] for r in spans} == {i for i, _ in docs}
    held = dict(docs)
    for r in spans:
        piece = held[r["doc_id"]].encode()[r["start"] : r["start"] + r["bytes"]].decode()
        assert sum(piece in t for t in held.values()) >= 2 and r["removed"] == (r["doc_id"] != r["first_doc_id"])


def _pieces(text):
    data, starts = np.frombuffer(text, np.uint8), np.array([0])
    h = cdc.gear(data)
    begin, _, owner = cdc.words_of(data, starts, h)
    first = begin[cdc.chunk_starts(begin, owner, starts, h)[0]].tolist()
    return [text[a:b] for a, b in zip(first, [*first[1:], len(text)], strict=True)]


def test_chunks_move_with_their_content():
    text = _prose(random.Random(5), 400).encode()
    assert b"".join(_pieces(text)) == text and len(_pieces(text)) > 20
    assert len(set(_pieces(text)) - set(_pieces(text[:700] + b" inserted words" + text[700:]))) <= 3


@pytest.mark.parametrize("longest", [1, 2, 8])
def test_every_passage_holds_a_whole_chunk(longest):
    rng = random.Random(longest)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, longest))) for _ in range(n))
    for _ in range(200):
        passage = prose(50)
        one, two = (set(_pieces(f"{prose(rng.randint(0, 60))} {passage} {prose(rng.randint(0, 60))}".strip().encode())) for _ in range(2))
        assert any(p in passage.encode() for p in one & two)


def test_cutting_gives_whole_characters_back(make):
    rng = random.Random(7)
    passage = _prose(rng, 90).replace("a", "é").replace("o", "ñ")
    docs = make((1, _prose(rng, 50) + passage), (2, _prose(rng, 50) + passage + "Ende"), (3, "short"), (4, None))
    spans = cdc.repeated_spans(docs)
    out = {r["doc_id"]: r["text"] for r in cdc.without_repeats(docs, spans).collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert out[1] == before[1] and out[3] == "short" and out[4] is None
    cuts = sorted((r["start"], r["bytes"]) for r in spans.collect() if r["doc_id"] == 2)
    raw, at, kept = before[2].encode(), 0, b""
    for start, size in cuts:
        kept, at = kept + raw[at:start], start + size
    assert out[2] == (kept + raw[at:]).decode() and len(out[2]) < len(before[2]) / 2


def test_repeated_words_are_repeats_too(make):
    rng = random.Random(13)
    docs = make((1, _prose(rng, 30) + " of the" * 80 + " " + _prose(rng, 30)), (2, _prose(rng, 77) + " of the" * 70 + " " + _prose(rng, 9)))
    assert {r["doc_id"] for r in cdc.repeated_spans(docs).collect()} == {1, 2}


def _exact_words(docs, n=50):
    """Words (by place) of each document that lie in n words, with their spaces, which another document holds."""
    holders, places = {}, {}
    for i, text in docs:
        words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x00-\x20]+", text.encode())]
        for k in range(len(words) - n + 1):
            piece = text.encode()[words[k][0] : words[k + n - 1][1]]
            holders.setdefault(piece, set()).add(i)
            places.setdefault(piece, []).append((i, k))
    return {(i, k + j) for p, own in holders.items() if len(own) > 1 for i, k in places[p] for j in range(n)}


@pytest.mark.parametrize(("letters", "longest"), [("abcdefghijklmnoprstuvw", 9), ("abcdefghijklm", 2), ("абвгдежзиклмнопрст", 9), ("ab", 1)])
def test_repeats_equal_brute_force(make, letters, longest):
    rng = random.Random(longest)
    prose = lambda n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n))
    docs = []
    for k in range(40):
        passage = prose(rng.choice([49, 50, 51, 60]))
        docs += [(2 * k + d, f"{prose(rng.randint(0, 70))} {passage}\n{prose(rng.randint(0, 70))}") for d in range(2)]
    found = set()
    for r in cdc.repeated_spans(make(*docs)).collect():
        raw = dict(docs)[r["doc_id"]].encode()
        before = len(raw[: r["start"]].split())
        assert len(raw[r["start"] : r["start"] + r["bytes"]].split()) == r["words"]
        found |= {(r["doc_id"], before + k) for k in range(r["words"])}
    assert found == _exact_words(docs) and len(found) > 2_000


def test_long_runs_without_spaces_are_cut_by_content(make):
    rng = random.Random(41)
    passage, *rest = ("".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n)) for n in (1_500, 700, 900, 1_100, 300))
    spans = cdc.repeated_spans(make((1, rest[0] + passage + rest[1]), (2, rest[2] + passage), (3, rest[3]), (4, "y" * 200_000))).collect()
    assert {r["doc_id"] for r in spans} == {1, 2}
    assert all(0.8 * len(passage.encode()) < sum(r["bytes"] for r in spans if r["doc_id"] == i) <= len(passage.encode()) for i in (1, 2))


def test_repeats_within_a_document_equal_brute_force(make):
    rng = random.Random(43)
    docs = []
    for i in range(20):
        parts = [_prose(rng, rng.choice([20, 49, 50, 70])) for _ in range(4)]
        docs.append((i, " ".join(rng.choice(parts) for _ in range(7))))
    docs += [(30, docs[3][1]), (31, " of the" * 80 + " " + _prose(rng, 60))]
    places = {}
    for i, text in docs:
        words = text.split()
        for k in range(len(words) - 49):
            places.setdefault(tuple(words[k : k + 50]), []).append((i, k))
    want = {(i, k + j) for own in places.values() if len(own) > 1 for i, k in own for j in range(50)}
    frame = make(*docs, docs[0])
    spans = cdc.repeated_spans(frame, within=True)
    found = set()
    for r in spans.collect():
        before = len(dict(docs)[r["doc_id"]].encode()[: r["start"]].split())
        found |= {(r["doc_id"], before + k) for k in range(r["words"])}
    assert found == want
    left = {r["doc_id"]: r["text"] for r in cdc.without_repeats(frame, spans).collect()}
    assert {w for t in left.values() for w in t.split()} == {w for _, t in docs for w in t.split()}
    assert left[31].split()[:51] == ["of", "the"] * 25 + ["of"] and len(left[31].split()) == 51 + 60


def test_every_passage_keeps_one_holder(make):
    rng = random.Random(17)
    a, b, c = (_prose(rng, n) for n in (60, 150, 60))
    # 7 is the first of b and c, but not of a beside them; 8 and 9 repeat a, b and c in a row
    docs = make((5, f"{_prose(rng, 20)} {a} {_prose(rng, 20)}"), *((i, f"{_prose(rng, 20)} {a} {b} {c} {_prose(rng, 20)}") for i in (7, 8, 9)), (10, f"{a} {_prose(rng, 20)} {c}"))
    spans = cdc.repeated_spans(docs)
    assert sorted((r["doc_id"], r["words"], r["first_doc_id"], r["removed"]) for r in spans.collect()) == [
        (5, 60, 5, False), (7, 60, 5, True), (7, 210, 7, False), *[(i, n, f, True) for i in (8, 9) for n, f in ((60, 5), (210, 7))], (10, 60, 5, True), (10, 60, 7, True)
    ]
    left = [" ".join(r["text"].split()) for r in cdc.without_repeats(docs, spans).collect()]
    assert [sum(p in t for t in left) for p in (a, f"{b} {c}")] == [1, 1]


def test_no_word_of_chained_passages_is_lost(make):
    rng = random.Random(29)
    parts = [_prose(rng, rng.choice([25, 40, 60])) for _ in range(12)]
    texts = {i: " ".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for i in range(40)}
    docs = make(*texts.items())
    spans = cdc.repeated_spans(docs)
    rows = sorted((r["doc_id"], r["start"], r["bytes"]) for r in spans.collect())
    assert all(x[0] != y[0] or x[1] + x[2] <= y[1] for x, y in zip(rows, rows[1:], strict=False))  # no overlap
    left = {r["doc_id"]: r["text"] for r in cdc.without_repeats(docs, spans).collect()}
    words = lambda some: {w for t in some for w in t.split()}
    assert words(left.values()) == words(texts.values()) and not _exact_words(list(left.items())) - _exact_words(list(texts.items()))
    assert sum(len(t) for t in left.values()) < sum(len(t) for t in texts.values()) / 3


def test_substring_edges(make):
    rng = random.Random(9)
    text = _prose(rng, 100)
    docs = make((1, None), (2, ""), (None, text), (3, text), (3, text), (4, "y" * 200_000)).withColumn("at", F.lit("clash"))
    assert cdc.repeated_spans(docs).count() == 0  # one document twice is no repeat
    rows = cdc.repeated_spans(docs.unionByName(make((5, text)).withColumn("at", F.lit("x")))).collect()
    assert sorted((r["doc_id"], r["removed"]) for r in rows) == [(3, False), (5, True)]
    assert cdc.repeated_spans(docs.where("false")).count() == 0


def test_substring_query(spark, sf_dir):
    assert cdc.op10_substrings(spark, sf_dir).columns == ["doc_id", "start", "bytes", "words", "first_doc_id", "removed"]

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.stemmers import english, russian
from tessera.operators import fusion, ranking, vectors


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adjustable", "adjust"), ("adoption", "adopt"), ("rate", "rate"), ("controlling", "control"), ("roll", "roll")])
def test_english(word, stem):
    assert english(word) == stem


@pytest.mark.parametrize("word, stem", [("книги", "книг"), ("красивая", "красив"), ("важнейшие", "важн"), ("работавший", "работа"), ("вилась", "вил"), ("возможность", "возможн"), ("длинный", "длин"), ("столами", "стол"), ("ёлка", "елк"), ("мгл", "мгл")])
def test_russian(word, stem):
    assert russian(word) == stem


def _tokens(spark, given, analyser):
    return spark.range(1).select(text.tokens(F.lit(given), analyser)).first()[0]


def test_tokens(spark):
    assert _tokens(spark, "It's v1.2, foo_bar-x9", "simple") == ["it", "s", "v1", "2", "foo_bar", "x9"]
    assert _tokens(spark, "It's v1.2 a.b 3.", "en") == ["it's", "v1.2", "a.b", "3"]
    # lower case first: camel case is not split; letters and digits are
    assert _tokens(spark, "camelCase foo_bar x9", "code") == ["camelcase", "foo_bar", "foo", "bar", "x9", "x", "9"]


def test_terms(spark):
    docs = spark.createDataFrame([(1, "The cats and John's cat"), (2, "кошки и кошка"), (3, None)], "doc_id long, text string")
    en = {(r["doc_id"], r["term"]): r["tf"] for r in text.term_counts(docs, "en").collect()}
    assert en[1, "cat"] == 2 and en[1, "john"] == 1 and (1, "the") not in en
    ru = {(r["doc_id"], r["term"]): r["tf"] for r in text.term_counts(docs, "ru").collect()}
    assert ru[2, "кошк"] == 2 and (2, "и") not in ru
    with pytest.raises(ValueError):
        text.term_counts(docs, "xx")


def test_cleaned(spark):
    given = "ﬁne​  text\t\there \n\n  hyphen-\nated end\n"
    rows = spark.createDataFrame([(given,), (None,)], "t string")
    assert [r[0] for r in rows.select(text.cleaned("t")).collect()] == ["fine text here\nhyphenated end", None]


def test_bm25_orders_by_rarity_and_filters_after_statistics(spark):
    docs = spark.createDataFrame([(1, "apple pear"), (2, "apple apple apple fig"), (3, "fig fig"), (4, "plum")], "doc_id long, text string")
    posted = ranking.postings(docs, "simple")
    all_scores = {r["doc_id"]: r["score"] for r in ranking.bm25(posted, ["apple", "pear"]).collect()}
    assert set(all_scores) == {1, 2} and all_scores[1] > all_scores[2]
    one = ranking.bm25(posted, ["apple", "pear"], within=docs.where("doc_id = 2").select("doc_id")).collect()
    assert [(r["doc_id"], r["score"]) for r in one] == [(2, all_scores[2])]
    assert ranking.bm25(posted, []).count() == 0


def _list(spark, *ids):
    return spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "id string, rank int")


def test_rrf_ties_and_order_of_lists(spark):
    for lists, want in (((["a", "b"], ["b", "c"]), "bac"), ((["a"], ["b"]), "ab"), ((["a", "b", "c"], []), "abc"), ((["b", "a"], ["a", "b"]), "ab")):
        for order in (lists, lists[::-1]):
            fused = ranking.top(fusion.rrf([_list(spark, *x) for x in order]), 10, "id").orderBy("rank")
            assert "".join(r["id"] for r in fused.collect()) == want


def test_shortlist():
    assert (fusion.shortlist(3, True), fusion.shortlist(10, True), fusion.shortlist(10, False)) == (32, 60, 10)
    for n in (0, 61):
        with pytest.raises(ValueError):
            fusion.shortlist(n, True)


def test_symbols(spark):
    rows = spark.createDataFrame([("a", ["Foo", "Bar"]), ("b", []), ("c", None)], "id string, symbols array<string>")
    hits = rows.where(ranking.symbol_hit(F.col("symbols"), ["", "foo", "BAR"]))
    assert [r["id"] for r in hits.collect()] == ["a"]
    assert rows.where(ranking.symbol_hit(F.col("symbols"), None)).count() == 0


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, [2.0, 0.0])], "vec_id long, embedding array<float>")
    near = vectors.knn(rows, [3.0, 0.0], 3).collect()
    assert [(r["vec_id"], round(r["score"], 6)) for r in near] == [(1, 1.0), (4, 1.0), (3, 0.707107)]
    assert abs(float((vectors.hashed_embedding("some text") ** 2).sum()) - 1) < 1e-9
    assert not vectors.hashed_embedding("").any()

"""Every operator and stage with clashing columns, nulls, repeated rows and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import op01_secrets, op02_sharding, op03_language, op04_lm_scoring, op05_toxicity, op06_mixing, op07_jaccard_join, op08_decontamination, op09_neighbours, op10_substrings

NAMES = ["extra", "whole", "size", "times", "target", "source_size", "score", "predicted", "passages", "shard", "slot", "row", "value", "key", "chunk", "bucket", "labels", "cid", "rep", "n",
         "__hi", "__lo", "__sub", "__start", "__rank", "__part", "__parts", "__quota", "__plan", "__copy", "__row", "__rest", "__h", "__w", "class_id", "words", "marks", "shared", "version"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(77)
    prose = lambda n: " ".join("".join(rng.choice("abdefhiklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows = [(i, prose(rng.randint(1, 90)), "ab"[i % 2], f"s{i % 3}" if i % 11 else None) for i in range(60)]
    rows += [(60, rows[3][1], "a", "s0"), rows[5], (None, rows[7][1], None, "s1"), (None, None, None, None), (61, "", "a", "s1"), (5, prose(70), "b", "s2"), (62, "x" * 100_000, "a", "s2")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select("*", *[F.concat_ws("/", F.lit(c), "doc_id").alias(c) for c in NAMES])


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, docs):
    at = str(tmp_path_factory.mktemp("edges"))
    spark.createDataFrame([(0, "one two three four five six seven")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs.where("doc_id is not null").select("doc_id", F.lit(1).alias("quality"), F.lit(0).cast("long").alias("toxic")).write.parquet(f"{at}/labels.parquet")
    return at


def _model(docs):
    return op05_toxicity.fit(docs.select("doc_id", "text", (F.col("doc_id") % 2).alias("toxic")))


OPERATORS = {
    "op1": lambda d: op01_secrets.scan(d.withColumn("path", F.col("source")), op01_secrets.made_findings(d.sparkSession, 600)),
    "op2": lambda d: op02_sharding.shard_documents(d, 5),
    "op3": lambda d: op03_language.identify(d, op03_language.learn(d)),
    "op4": lambda d: op04_lm_scoring.score_against_target(d.withColumn("in_target", F.col("lang") == "a")),
    "op5": lambda d: op05_toxicity.score(d, _model(d)),
    "op6": op06_mixing.mix,
    "op7": op07_jaccard_join.jaccard_join,
    "op8": lambda d: op08_decontamination.contaminated(d, d.sparkSession.createDataFrame([(0, "one two three four five six")], "item_id long, text string")),
    "op9": lambda d: op09_neighbours.neighbours(d.select(F.col("doc_id").alias("vec_id"), F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")).alias("embedding"), *[c for c in d.columns if c in NAMES]), F.col("vec_id") % 20 == 0),
    "op10": op10_substrings.repeated_spans,
}
#: Columns that an operator returns of its own, in place of the caller's.
MINE = {"op2": {"size", "shard", "slot"}, "op5": {"score", "predicted", "passages"}, "op6": {"size", "source_size", "target", "times"}}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(name, docs, clashing):
    plain, odd = OPERATORS[name](docs), OPERATORS[name](clashing)
    own = [c for c in plain.columns if c not in NAMES or c not in odd.columns or c in MINE.get(name, NAMES)]
    arranged = lambda df: sorted(map(str, df.select([F.col(f"`{c}`").cast("string") for c in own]).collect()))
    assert arranged(plain) == arranged(odd)
    for c in set(odd.columns) & set(NAMES) - set(plain.columns):  # the caller's values
        assert odd.where(~F.col(f"`{c}`").eqNullSafe(F.concat_ws("/", F.lit(c), "doc_id"))).count() == 0
    if name in MINE:
        assert set(clashing.columns) <= set(odd.columns)
    assert OPERATORS[name](clashing.where("false")).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(name, spark, docs, clashing, tables):
    function = dict(corpus_pipeline.STAGES)[name]
    plain, odd = function(spark, docs, tables), function(spark, clashing, tables)
    kept = lambda df: sorted(str((r["doc_id"], r["text"])) for r in df.select("doc_id", "text").collect())
    assert kept(plain) == kept(odd) and len(kept(odd)) > 0
    mine = MINE["op2"] if name == "sharding" else set()
    assert [c for c in odd.columns if c not in mine] == [c for c in clashing.columns if c not in mine]
    for c in set(NAMES) - mine:
        assert odd.where(~F.col(f"`{c}`").eqNullSafe(F.concat_ws("/", F.lit(c), "doc_id"))).count() == 0
    assert function(spark, clashing.where("false"), tables).count() == 0


def test_near_copies_are_judged_by_row(spark, docs, tables):
    rows = corpus_pipeline.drop_near_copies(spark, docs, tables).collect()
    texts = [r["text"] for r in rows]
    held = [r["text"] for r in docs.collect()]
    assert sorted(t for t in texts if t) == sorted({t for t in held if t}) and len([r for r in rows if r["doc_id"] == 5]) == 2
    assert sum(t is None for t in texts) == 1 and "" in texts


def test_many_rows_alike_are_split(make):
    rows = op02_sharding.shard_documents(make(*[(7, "the same row") for _ in range(300)], *[(i, f"text {i}") for i in range(100, 400)]), 6).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r["shard"], []).append(r)
    total = sum(r["size"] for r in rows)
    assert all(abs(sum(r["size"] for r in own) - total / 6) <= 60 and sorted(r["slot"] for r in own) == list(range(len(own))) for own in sizes.values())
    assert len(rows) == 600 and len(sizes) == 6


def test_every_language_is_learned(make):
    docs = make(*[(i, f"{c * 3} {c}a{c}b" * 3, c) for i, c in enumerate("opqrstuvw")])
    got = {r["doc_id"]: r["lang_pred"] for r in op03_language.identify(docs, op03_language.learn(docs)).collect()}
    assert got == dict(enumerate("opqrstuvw"))


def test_a_toxic_last_word_counts_before_empty_texts(make):
    rng = random.Random(4)
    prose = lambda: " ".join("".join(rng.choice("abdehi") for _ in range(5)) for _ in range(12))
    model = op05_toxicity.fit(make(*[(i, f"{prose()} {'grakfoul grakfoul' if i % 2 else prose()}") for i in range(400)]).withColumn("toxic", F.col("doc_id") % 2))
    texts = [(1, "plain words grakfoul"), (2, None), (3, "")]
    both = [{r["doc_id"]: r["score"] for r in op05_toxicity.score(make(*t).coalesce(1), model).collect()} for t in (texts, texts[::-1])]
    assert both[0] == both[1] and both[0][1] > both[0][2]


def test_ties_of_one_item_id(make, spark):
    item = "one two three four five six seven"
    items = spark.createDataFrame([(0, item), (0, item + " eight nine")], "item_id long, text string")
    rows = op08_decontamination.contaminated(make((1, item + " eight nine ten")), items).collect()
    assert [(r["n_shingles"], r["shared"]) for r in rows] == [(5, 5)]

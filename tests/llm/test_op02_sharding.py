import zlib

from pyspark.sql import functions as F

from tessera.llm import op02_sharding as op


def _check(rows, shards, largest, total):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    for k in range(shards):
        assert abs(sum(r["size"] for r in by.get(k, [])) - total / shards) <= largest + 2


def test_equal_bytes_and_gapless_slots(make):
    docs = make(*[(i, "x" * (i * 37 % 400)) for i in range(600)])
    rows = op.shard_documents(docs, 7).collect()
    assert len(rows) == 600
    _check(rows, 7, 416, sum(16 + i * 37 % 400 for i in range(600)))


def test_a_text_with_a_third_of_all_rows_is_split(make):
    docs = make(*[(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(900)])
    _check(op.shard_documents(docs, 8).collect(), 8, 30, sum(16 + len("same text" if i % 3 == 0 else f"text {i}") for i in range(900)))


def test_edges(make):
    docs = make((1, None), (2, ""), (None, "a"), (3, "é"), (3, "é"), (4, "y" * 300_000)).withColumn("hi", F.lit(1)).withColumn("slot", F.lit("old")).withColumn("shard", F.lit("old"))
    rows = op.shard_documents(docs, 3).collect()
    assert len(rows) == 6 and {r["size"] for r in rows} == {16, 17, 18, 300_016}
    assert {r["hi"] for r in rows} == {1} and all(isinstance(r["slot"], int) for r in rows)
    assert op.shard_documents(make().where("false"), 3).count() == 0


def test_numbering_in_many_tasks(make, monkeypatch):
    monkeypatch.setattr(op, "ROWS_PER_TASK", 20)
    docs = make(*[(i, f"t{i}") for i in range(500)])
    _check(op.shard_documents(docs, 4).collect(), 4, 20, sum(16 + len(f"t{i}") for i in range(500)))


def test_splitters_against_brute_force(spark):
    keys = sorted((hash((i, "k")) % 10_000 - 5_000, i, 10 + i % 90) for i in range(2_000))
    rows = spark.createDataFrame(keys, "__hi long, __lo long, size long")
    total = sum(k[2] for k in keys)
    for k, (hi, lo) in enumerate(op.splitters(rows, 5), 1):
        below = sum(s for a, b, s in keys if (a, b) < (hi, lo))
        assert abs(below - total * k / 5) <= 100


def test_query(spark, sf_dir):
    out = op.op2_sharding(spark, sf_dir)
    assert out.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in out.collect():
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import blocks, paths

SCHEMA = "i int, total int, blocks array<struct<start_line:int,end_line:int,title:string,kind:string,symbols:array<string>>>"
CASES = [
    (10, [(1, 4), (5, 10)], [(1, 4), (5, 10)]), (10, [(3, 4), (8, 9)], [(1, 6), (7, 10)]), (10, [(1, 6), (4, 10)], [(1, 6), (7, 10)]),
    (10, [(1, 8), (3, 5), (9, 10)], [(1, 8), (9, 10)]), (10, [(5, 10), (1, 4)], [(1, 4), (5, 10)]), (10, [(-2, 3), (4, 99)], [(1, 3), (4, 10)]),
    (10, [(11, 12)], [(1, 10)]), (10, [], [(1, 10)]), (1, [(1, 1)], [(1, 1)]), (14, [(1, 10), (13, 14)], [(1, 11), (12, 14)]),
    (15, [(1, 10), (14, 15)], [(1, 12), (13, 15)]),
]


def _tiled(spark, cases):
    rows = [(i, total, [(a, b, f"t{k}", "k", []) for k, (a, b) in enumerate(given)]) for i, (total, given) in enumerate(cases)]
    out = spark.createDataFrame(rows, SCHEMA).select("i", blocks.normalised("blocks", "total").alias("t"), blocks.coverage(blocks.normalised("blocks", "total"), "total").alias("c")).collect()
    return {r["i"]: ([(b["start_line"], b["end_line"]) for b in r["t"]], r["c"], [b["title"] for b in r["t"]]) for r in out}


def test_cases(spark):
    got = _tiled(spark, [c[:2] for c in CASES])
    assert [got[i][0] for i in range(len(CASES))] == [c[2] for c in CASES]
    assert got[7][2] == ["logic"] and all(v[1] == 100 for v in got.values())


def test_tiles_without_gap_or_overlap(spark):
    rng = random.Random(3)
    cases = [(rng.randint(1, 40), [(a := rng.randint(-3, 45), a + rng.randint(-2, 15)) for _ in range(rng.randint(0, 8))]) for _ in range(300)]
    for i, (tiles, _, _) in _tiled(spark, cases).items():
        total = cases[i][0]
        assert tiles[0][0] == 1 and tiles[-1][1] == total, cases[i]
        assert all(b[0] == a[1] + 1 for a, b in zip(tiles, tiles[1:], strict=False)), cases[i]
        assert all(a <= b for a, b in tiles), cases[i]


def test_equal_ranges_keep_their_order(spark):
    assert _tiled(spark, [(10, [(1, 5), (1, 5), (6, 10)])])[0][2] == ["t0", "t2"]


def test_diagnostics(spark):
    rows = [("a", 0, 3, 4, 10), ("a", 1, 8, 12, 10), ("b", 0, 5, 6, 6), ("b", 1, 1, 5, 6)]
    got = {r["path"]: r.asDict() for r in blocks.diagnostics(spark.createDataFrame(rows, "path string, place int, start_line int, end_line int, total int")).collect()}
    assert got["a"]["gaps"] == 2 and got["a"]["gap_lines"] == 5 and got["a"]["ends_out"] == 1 and not got["a"]["unsorted"] and got["a"]["raw_coverage"] == 100
    assert got["b"]["unsorted"] and got["b"]["overlap_count"] == 1 and got["b"]["overlap_lines"] == 1


def test_structural_splitter_and_chunks(spark):
    text = "# Title\n\nintro\n\ndef f():\n    pass\n\nclass A:\n    x = 1\n"
    rows = spark.createDataFrame([("p/a.py", text)], "path string, text string").withColumn("blocks", blocks.split_with()("text"))
    out = blocks.chunks(rows).orderBy("chunk_id").collect()
    assert "\n".join(r["text"] for r in out) == text
    assert out[0]["id"] == f"p/a.py#1/{len(out)}" and {"f", "A"} <= {s for r in out for s in r["symbols"]}
    assert len(blocks.structural("\n\n".join(f"para {i}" for i in range(200)))) == blocks.MOST_BLOCKS


@pytest.mark.parametrize("given, want", [("./../a//b.py", "a/b.py"), ("/../a", "../a"), ("  .\\x\\\\y ", "x/y"), ("", ""), ("../../..//z", "z")])
def test_normalise(spark, given, want):
    assert spark.range(1).select(paths.normalise(F.lit(given))).first()[0] == want


def test_path_columns(spark):
    names = ["a/b.tar.GZ", ".profile", "x/y.PY", "noext", "d.d/e"]
    rows = spark.createDataFrame([(n,) for n in names], "p string")
    got = [tuple(r) for r in rows.select(paths.extension("p"), paths.language("p"), paths.mime("p")).collect()]
    assert got == [("gz", "text", ""), ("", "text", ""), ("py", "python", "text/x-python"), ("", "text", ""), ("", "text", "")]
    assert spark.range(1).select(paths.blob_oid(F.lit("hello\n"))).first()[0] == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert paths.prefix_of("./ja*va//x") == "java/x" and paths.prefix_of("*") == ""


def test_json_and_escapes(spark):
    row = spark.createDataFrame([("ü<&\"'", None)], "b string, a int")
    assert row.select(paths.canonical_json({"b": F.col("b"), "a": F.col("a")})).first()[0] == '{"a":null,"b":"ü<&\\"\'"}'
    assert row.select(paths.html_escape("b")).first()[0] == "ü&lt;&amp;&quot;&#x27;"
    assert row.select(paths.stripped(F.lit(" \n "))).first()[0] is None
    assert row.select(paths.keyword(F.lit("Éçole Straße"))).first()[0] == "ecole strasse"

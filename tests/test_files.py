import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.__main__ import main
from tessera.functions import blocks, paths
from tessera.operators import ledger, lines, ranking, sync
from tessera.plans import index, sqltool
from tessera.plans.search import search
from tessera.sources import databases, files
from tessera.sources.store import Store
from tessera.streaming import ingest


def test_scan_sees_hidden_names(spark, tmp_path):
    for name in ("a.txt", ".hidden", "_under/x.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x\xff")
    got = files.scan(spark, str(tmp_path)).select("path", "length", F.base64("content").alias("c")).collect()
    assert sorted((r["path"], r["length"]) for r in got) == [(".hidden", 2), ("_under/x.py", 2), ("a.txt", 2)]
    assert files.scan(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("patterns, path, want", [
    ("*.log", "a/b.log", True), ("/top", "top/x", True), ("/top", "a/top", False), ("build/", "a/build/x", True), ("build/", "build", False), ("a/**/z", "a/b/c/z", True),
    ("a/**/z", "a/z", True), ("*.log\n!keep.log", "keep.log", False), ("x # note", "x", True), ("# all", "all", False), ("f?o[ab]", "fxoa", True), ("doc/*.md", "doc/a/b.md", False),
])
def test_ignore(spark, patterns, path, want):
    assert spark.range(1).select(files.ignored(F.lit(path), files.ignore_rules(patterns))).first()[0] is want


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def test_extractors(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    given = [
        (".docx", _zip({"word/document.xml": f"<w:d {w}><w:p><w:t>one</w:t><w:t> two</w:t></w:p><w:p><w:t>three</w:t></w:p></w:d>"}), "one two\nthree"),
        (".pptx", _zip({"ppt/slides/slide1.xml": f"<s {a}><a:p><a:t>hi</a:t></a:p></s>"}), "hi"),
        (".epub", _zip({"c.xhtml": "<p>ch</p>"}), "ch"),
        (".html", b"<head>x</head><p>a <b>b</b></p><script>no</script><div>c</div>", "a b\nc"),
        (".rtf", rb"{\rtf1 a\par b \'e9}", "a\nb é"),
        (".csv", b"x,y\n1,\xe9\n", None),
        (".exe", b"\xff", None),
        (".docx", b"broken", None),
    ]
    rows = spark.createDataFrame([(i, s, b) for i, (s, b, _) in enumerate(given)], "i int, s string, c binary")
    got = {r["i"]: r["x"] for r in rows.select("i", files.extracted()("s", "c").alias("x")).collect()}
    assert all(got[i]["text"] == t for i, (_, _, t) in enumerate(given) if t)
    assert "1" in got[5]["text"] and "no extractor" in got[6]["error"] and got[7]["error"]


def test_mask_tree_isolates_failures(spark, tmp_path):
    src, dst = tmp_path / "src", str(tmp_path / "dst")
    src.mkdir()
    (src / "a.txt").write_text("password=abcdef\r\n")
    (src / "b.bin").write_bytes(b"\xff\xfe")
    (src / "c.log").write_text("x")
    errors = index.mask_tree(spark, str(src), dst, ignore="*.log")
    assert [r["path"] for r in errors.collect()] == ["b.bin"]
    assert [tuple(r) for r in spark.read.parquet(dst).collect()] == [("a.txt", "password=[REDACTED]\n")]


def _scanned(spark, tree):
    return spark.createDataFrame([(k, bytearray(v.encode())) for k, v in tree.items()], "path string, content binary")


def test_build_is_incremental_and_idempotent(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    one = {"a.py": "def f():\n    pass\n", "b.md": "# T\n\ntext", "empty": "", "skip.log": "x"}
    assert index.build(spark, _scanned(spark, one), store, "*.log") == {"index": 3}
    first = store.current()
    assert {r["path"] for r in store.manifest().collect()} == {"a.py", "b.md"}
    assert store.chunks().where("size(embedding) != 1024").count() == 0
    again = index.build(spark, _scanned(spark, {k: one[k] for k in ("a.py", "b.md", "skip.log")}), store, "*.log")
    assert again == {"skip": 2} and store.current() == first
    two = {"a.py": "def g():\n    pass\n", "c.sql": "create table t (x int)"}
    assert index.build(spark, _scanned(spark, two), store) == {"reindex": 1, "index": 1, "delete": 1}
    assert {r["path"] for r in store.chunks().select("path").distinct().collect()} == {"a.py", "c.sql"}
    found = search(store.chunks(), "create table", top_n=1, use_reranker=False).collect()
    assert found[0]["path"] == "c.sql" and found[0]["rank"] == 1
    assert search(store.chunks(), "", path_prefix="a*", top_n=5, symbols=["G"]).first()["path"] == "a.py"


def test_diff_actions(spark):
    current = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", None), ("e", None)], "path string, hash string")
    stored = spark.createDataFrame([("a", "1"), ("b", "1"), ("d", "1"), ("f", "1")], "path string, hash string")
    got = {r["path"]: r["action"] for r in sync.diff(current, stored).collect()}
    assert got == {"a": "skip", "b": "reindex", "c": "index", "d": "delete", "e": "none", "f": "delete"}


def test_sql_guard(spark):
    spark.range(3).createOrReplaceTempView("three")
    allowed = ["SELECT * FROM three", "WITH a AS (SELECT id FROM three) SELECT max(id) FROM a", "SELECT (SELECT 1)", "(SELECT 1) UNION ALL (SELECT 2)", "VALUES (1)"]
    refused = ["INSERT INTO three VALUES (1)", "SELECT 1; DROP TABLE x", "CREATE VIEW v AS SELECT 1", "nonsense", "", "SHOW TABLES", "FROM three INSERT INTO x SELECT id", "CACHE TABLE three", "DESCRIBE three", "BEGIN SELECT 1; END"]
    assert [q for q in allowed if not sqltool.is_query(spark, q)] == []
    assert [q for q in refused if sqltool.is_query(spark, q)] == []
    assert sqltool.payload(spark, "SELECT id FROM three ORDER BY id", 2)["rows"] == [{"id": 0}, {"id": 1}]
    assert sqltool.payload(spark, "DROP TABLE x")["error"] == sqltool.REJECTED
    tools = sqltool.Tools()
    tools.add_session(spark, "here", "all")
    assert tools.describe() == {"here": "all"} and tools.call("here", select="SELECT 1 AS x")["rows"] == [{"x": 1}]
    assert "error" in tools.call("other")
    more = ["SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT `reflect`('a', 'b')", "SELECT 1 WHERE EXISTS (SELECT try_reflect('a', 'b'))", "SELECT * FROM parquet.`/etc`", "SELECT * FROM csv.`x`", "WITH a AS (SELECT * FROM json.`/x`) SELECT * FROM a"]
    assert [q for q in more if sqltool.is_query(spark, q)] == []
    fine = ["SELECT * FROM range(3)", "SELECT explode(array(1))", "SELECT * FROM three a JOIN three b USING (id) WHERE a.id IN (SELECT id FROM three)", "SELECT id, sum(id) OVER (ORDER BY id) s FROM three GROUP BY id HAVING id > 0 LIMIT 3 OFFSET 1",
            "SELECT * FROM three PIVOT (count(*) FOR id IN (1))", "SELECT * FROM three, LATERAL (SELECT three.id + 1 AS n)", "SELECT * FROM default.three", "SELECT 1 UNION SELECT 2 INTERSECT SELECT 2 EXCEPT SELECT 3"]
    assert [q for q in fine if not sqltool.is_query(spark, q)] == []


def test_payload_is_whole_and_bounded_in_time(spark):
    spark.range(2_500).createOrReplaceTempView("many")
    assert len(sqltool.payload(spark, "SELECT id FROM many")["rows"]) == 2_500
    cut = sqltool.payload(spark, "SELECT id FROM many", 10)
    assert len(cut["rows"]) == 10 and cut["truncated"] and "truncated" not in sqltool.payload(spark, "SELECT 1 AS x", 1)
    slow = sqltool.payload(spark, "SELECT sum(id % 7) AS n FROM range(4000000000)", timeout=0.2)
    assert slow["error"] == "no result within 0.2 s" and slow["rows"] == []
    assert sqltool.payload(spark, "SELECT 1 AS x")["rows"] == [{"x": 1}]


def test_each_database_tool_asks_its_own(spark, monkeypatch, tmp_path):
    asked = []
    monkeypatch.setattr(databases, "table", lambda s, d, text: (asked.append((d.url, text)), s.createDataFrame([(d.url,)], "u string"))[1])
    tools, log = sqltool.Tools(), sqltool.QueryLog(spark, str(tmp_path / "log"))
    tools.add_databases(spark, {n: databases.Database(f"url-{n}", "a", "b", n) for n in ("one", "two")}, log)
    assert [tools.call(n, select="SELECT u FROM db.s.t")["rows"] for n in ("one", "two")] == [[{"u": "url-one"}], [{"u": "url-two"}]]
    assert asked == [(f"url-{n}", "SELECT u FROM db.s.t") for n in ("one", "two")] and tools.describe() == {"one": "one", "two": "two"}
    assert tools.call("one", select="DELETE FROM t")["error"] == sqltool.REJECTED and len(asked) == 2
    log.write()
    assert [(r["statement"], r["calls"]) for r in log.slowest(1).collect()][0][1] in (1, 2) and log.slowest().count() == 2


def test_databases():
    env = {"DB_1_URL": "u1", "DB_1_USERNAME": "a", "DB_1_PASSWORD": "p", "DB_1_TOOL_NAME": "one", "DB_2_URL": "u2", "DB_3_URL": "u3", "DB_3_USERNAME": "a", "DB_3_PASSWORD": "p", "DB_3_TOOL_NAME": "three", "DB_5_URL": "x"}
    assert list(databases.from_environment(env)) == ["one", "three"]
    assert databases.jdbc_url("jdbc:postgresql://u@h:1/d?x=y") == "jdbc:postgresql://h:1/d"
    for given, url in (("h", "jdbc:postgresql://h/"), (" H:5/d ", "jdbc:postgresql://h:5/d"), ("mysql://u:p@h//d#f", "jdbc:mysql://h/d"), (None, "jdbc:postgresql:///"), ("jdbc:h/d", "jdbc:postgresql://h/d")):
        assert databases.jdbc_url(given) == url
    assert databases.jdbc_url("h", "other") == "jdbc:postgresql://h/other"


def test_prefix_is_tidied_as_paths_are(spark):
    given = ["a*b", " ./../x//y ", "/../a", "\\\\src\\x", "***", "", "./.", "..//a"]
    rows = spark.createDataFrame([(k, g.replace("*", "")) for k, g in enumerate(given)], "k int, p string").select("k", paths.normalise("p").alias("p")).collect()
    assert {r["k"]: r["p"] for r in rows} == {k: paths.prefix_of(g) for k, g in enumerate(given)} and paths.prefix_of(None) == ""


def test_one_failing_file_is_its_own_error(spark, tmp_path):
    def fussy(text):
        if "bad" in text:
            raise RuntimeError("no blocks today")
        return blocks.structural(text)

    store = Store(spark, str(tmp_path / "store"))
    store.bootstrap()
    assert store.chunks().count() == 0 and store.current()
    counts = index.build(spark, _scanned(spark, {"a.py": "x = 1\n", "b.py": "bad\n", "c.py": ""}), store, splitter=fussy)
    assert counts == {"index": 3}
    assert {r["path"] for r in store.manifest().collect()} == {"a.py"} == {r["path"] for r in store.chunks().collect()}
    report = {r["path"]: r for r in store.report().collect()}
    assert report["b.py"]["error"] == "RuntimeError: no blocks today" and report["c.py"]["error"] == index.EMPTY and report["a.py"]["error"] is None
    assert all(r["seconds"] >= 0 for r in report.values())
    one = store.chunks().select("created_at").union(store.manifest().select("created_at")).distinct()
    assert one.count() == 1  # one time for a build
    again = index.build(spark, _scanned(spark, {"a.py": "x = 1\n", "b.py": "bad\n"}), store)
    assert again == {"skip": 1, "index": 1} and {r["path"] for r in store.manifest().collect()} == {"a.py", "b.py"}


def test_a_crash_before_the_pointer_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    index.build(spark, _scanned(spark, {"a.py": "x = 1\n"}), store)
    first = store.current()
    monkeypatch.setattr(Store, "_pointers", lambda self: [])  # another writer that has not seen the first
    with pytest.raises(Exception):  # noqa: B017
        store.commit(store.chunks(), store.manifest())
    monkeypatch.undo()
    assert store.current() == first and store.chunks().count() == 1


def test_masked_files_keep_their_paths(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", "x\ny"), ("c.md", "é"), ("../out", "z")], "path string, text string")
    index.export_files(rows, str(tmp_path / "safe"))
    found = {str(p.relative_to(tmp_path)): p.read_text(encoding="utf-8") for p in tmp_path.rglob("*") if p.is_file()}
    assert found == {"safe/a/b.txt": "x\ny", "safe/c.md": "é"}


def test_pages_are_appended(spark, tmp_path):
    at = str(tmp_path / "pages")
    talk = lambda *rows: spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ledger.append_pages(spark, at, talk((1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c")))
    ledger.append_pages(spark, at, talk((1, 2, "user", "d"), (3, 0, "user", "e")))
    assert sorted((r["conv_id"], r["page_no"]) for r in spark.read.parquet(at).collect()) == [(1, 1), (1, 2), (2, 1), (3, 1)]


def test_many_starts_are_merged_as_by_looking_at_all():
    import random

    def plainly(starts, end, most):
        starts = list(starts)
        while len(starts) > most:
            k = min(range(1, len(starts)), key=lambda i: (starts[i + 1] if i + 1 < len(starts) else end) - starts[i - 1])
            del starts[k]
        return starts

    rng = random.Random(2)
    for n in (1, 2, 60, 200):
        starts = [0, *sorted(rng.sample(range(1, 5 * n + 5), n))]
        assert blocks._merged(starts, 5 * n + 9, 50) == plainly(starts, 5 * n + 9, 50)
    assert len(blocks._merged(list(range(200_000)), 200_000, 50)) == 50


@pytest.mark.parametrize("filtered", [False, True])
def test_stored_index_scores_as_postings_do(spark, tmp_path, filtered):
    import random

    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(rng.randint(0, 30)))) for i in range(80)], "doc_id long, text string")
    stored = ranking.StoredIndex.build(docs, "simple", str(tmp_path / "index"), folders=4)
    within = docs.where("doc_id % 3 = 0").select("doc_id") if filtered else None
    for terms in (["alpha", "zeta", "none"], ["beta"], ["none"]):
        want = sorted(map(tuple, ranking.bm25(ranking.postings(docs, "simple"), terms, within=within).collect()))
        assert sorted(map(tuple, stored.bm25(terms, within).collect())) == want and (want or terms == ["none"])
    plan = stored.bm25(["alpha"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [folder" in plan


def test_ledger(spark):
    calls = spark.createDataFrame([(100, 40, None, 10), (None, 0, 200, 0)], "input long, cache_write long, cache_read long, output long")
    priced = ledger.cost(ledger.totals(calls)).first()
    assert (priced["paid"], priced["total"], priced["saved"]) == (170.0, 180.0, 170.0)
    talk = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", " "), (1, 2, "tool", "t"), (1, 3, "assistant", "ü")], "conv_id long, turn long, role string, text string")
    page = ledger.pages(talk).first()
    assert page["text"] == '[{"role":"user","text":"q"},{"role":"assistant","text":"ü"}]'
    wide = ledger.last_pages(ledger.pages(talk)).first()
    assert wide["page2"] == "" and wide["chars1"] == len(page["text"])


def test_lines(spark):
    table = spark.createDataFrame([("a", "x 1\ny\nx 2\n"), ("b", "")], "path string, text string")
    rows = lines.line_table(table)
    assert rows.count() == 5
    assert [r["line_no"] for r in lines.grep_context(rows, "y", 1, 1).orderBy("line_no").collect()] == [1, 2, 3]
    assert lines.grep(rows, "X", ignore_case=True).count() == 2 and lines.grep(rows, "x", invert=True).count() == 3
    assert [(r["line_no"], r["line"]) for r in lines.tail(table, 2).where("path = 'a'").orderBy("line_no").collect()] == [(3, "x 2"), (4, "")]
    assert lines.split_parts(rows, 2).where("path = 'a'").select("part").distinct().count() == 2
    data = spark.createDataFrame([(bytearray(b"\x00abcd\x01ef"),)], "c binary")
    assert data.select(lines.strings("c"), lines.octal_dump("c")).first()[0] == ["abcd"]
    assert spark.range(1).select(lines.dirname(F.lit("a/b/c")), lines.dirname(F.lit("x"))).first()[:] == ("a/b", ".")


def test_stream_indexes_each_batch(spark, tmp_path):
    src, state, seen = tmp_path / "in", str(tmp_path / "state"), []
    spark.range(5).selectExpr("cast(id as string) path", "cast('x' as binary) content").write.parquet(str(src))
    stream = spark.readStream.schema("path string, content binary").parquet(str(src))
    query = ingest.index_arrivals(stream, lambda batch: seen.append(batch.count()), state)
    query.awaitTermination()
    assert sum(seen) == 5


def test_migrations_and_unindexable(spark):
    rows = spark.createDataFrame([("db/V1__Initial_schema.sql",), ("db/V2_1__add_users.sql",), ("x.sql",)], "path string")
    assert sorted(tuple(r) for r in lines.migrations(rows).collect()) == [("db/V1__Initial_schema.sql", "1", "Initial schema"), ("db/V2_1__add_users.sql", "2_1", "add users")]
    assert [tuple(r) for r in index.unindexable(_scanned(spark, {"a": "x", "./b": ""})).collect()] == [("b", "empty file")]


def test_splitter_contract():
    good = {"start_line": 1, "end_line": 2, "title": "t", "kind": "k", "symbols": []}
    assert blocks.checked([good]) == [good]
    for bad in ([], [good] * 51, [good | {"title": "x" * 121}], [good | {"other": 1}], "text"):
        with pytest.raises(ValueError):
            blocks.checked(bad)


def test_command_line(spark, tmp_path, capsys):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def find_user():\n    pass\n")
    assert main(["mask", str(src), str(tmp_path / "safe")]) == 0
    assert main(["build", str(src), str(tmp_path / "store")]) == 0
    assert main(["search", str(tmp_path / "store"), "find user", "--top", "1", "--no-rerank"]) == 0
    assert '"path":"a.py"' in capsys.readouterr().out
    assert main(["sql", "/root/testdata/sf0.001", "SELECT count(*) AS n FROM nation"]) == 0
    assert json.loads(capsys.readouterr().out)["rows"] == [{"n": 25}]
    assert main(["sql", "/root/testdata/sf0.001", "DROP TABLE nation"]) == 1

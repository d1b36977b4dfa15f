"""Every registered query with SQL gives DuckDB's rows."""

import duckdb
import pytest

from tessera import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    return repr(value) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(name, spark, sf_dir, duck):
    got = queries.QUERIES[name](spark, sf_dir)
    want = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    columns = sorted(got.columns)
    assert columns == sorted(names)
    mine = sorted(tuple(_plain(r[c]) for c in columns) for r in got.collect())
    theirs = sorted(tuple(_plain(r[names.index(c)]) for c in columns) for r in want.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL) - {"main_search"}))
def test_runs(name, spark, sf_dir):
    assert queries.QUERIES[name](spark, sf_dir).collect()


def test_main_search(spark, sf_dir):
    rows = queries.QUERIES["main_search"](spark, sf_dir).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 11))
    assert all(r["path"].startswith("src1") for r in rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Queries of the subpackage: their names, and DuckDB's rows for those with SQL."""

import re

import duckdb
import pytest

from tessera.llm import registry


def test_ten_queries():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(name, spark):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = registry.QUERIES[name](spark, sf_dir)
    want = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    mine = sorted(tuple(str(r[c]) for c in names) for r in got.collect())
    assert mine == sorted(tuple(map(str, r)) for r in want.fetchall()) and mine

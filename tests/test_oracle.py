"""Registered queries against their DuckDB SQL on the smallest tables, where those are there."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"ladder_trace"}


def norm(rows):
    cell = lambda x: "" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(cell, r)) for r in rows)


def test_registration():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(entry.catalog.QUERIES) - SLOW))
def test_query_equals_sql(spark, name):
    df = entry.catalog.QUERIES[name](spark, SF)
    rows, columns = [tuple(r) for r in df.collect()], df.columns
    if name not in entry.catalog.ORACLE_SQL:
        assert columns
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(entry.catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(columns)
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert norm(rows) == norm(want)

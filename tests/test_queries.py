"""Every registered query against its oracle on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) and math.isfinite(x) else str(x) for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert plain([tuple(r[c] for c in cols) for r in got.collect()]) == plain([tuple(r[i] for i in at) for r in want.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() > 0

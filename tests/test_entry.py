"""Every query with SQL against DuckDB, on the smallest tables; names of the optional subpackage are left to its own tests."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from seqloom import queries as reference

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def plain(rows):
    def one(x):
        return None if x is None or isinstance(x, float) and math.isnan(x) else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(repr([one(x) for x in r]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(reference.QUERIES))
def test_query(spark, duck, name):
    got = reference.QUERIES[name](spark, D)
    columns = sorted(got.columns)
    want = duck.sql(reference.SQL[name])
    assert sorted(want.columns) == columns
    assert plain(got.select(*columns).collect()) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())

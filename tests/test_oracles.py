"""Every registered query against its SQL on the smallest given tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="given tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value + 0.0 if isinstance(value, (int, float)) else str(value)


def table(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    out = [tuple(plain(row[i]) for i in order) for row in data]
    return sorted(out, key=lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in r))


def test_registry_is_complete():
    assert entry.ORACLES.keys() == entry.QUERIES.keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", entry.QUERIES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = table(df.columns, df.collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == table(names, cursor.fetchall())
    assert got


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["z1", "z2", "s"] and df.count() > 0

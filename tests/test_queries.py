"""Every registered query against its SQL twin on the small tables."""

import math
import os
from collections import Counter

import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if type(value).__name__ == "Decimal":
        return float(value)
    return tuple(value) if isinstance(value, list) else value


@pytest.fixture(scope="module")
def database():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, database, name):
    frame = contract.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = Counter(tuple(map(plain, r)) for r in frame.select(*columns).collect())
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = database.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
    assert got == want


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.count() > 0 and "score" in rows.columns

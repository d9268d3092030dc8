"""Every query of the library against its SQL on the smallest tables; the training-data queries have tests of their own."""

import math
import os

import duckdb
import pytest

from stopwise import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert name in {"itineraries", "address_suggest", "places"}
        return
    out = duck.sql(sql)
    assert sorted(out.columns) == cols
    at = [out.columns.index(c) for c in cols]
    assert rows == sorted(tuple(plain(r[k]) for k in at) for r in out.fetchall())
    kinds = dict(df.dtypes)
    assert {c: KINDS.get(kinds[c]) for c in cols} == {c: str(out.types[out.columns.index(c)]) for c in cols}


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0

"""Every registered query against its DuckDB SQL."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from snapspark.domain import DRIVER_TABLES

# The training-data queries have tests of their own beside their subpackage.
QUERIES = {n: q for n, q in entry.queries().items() if n != "pipeline" and not re.match(r"op\d+_", n)}
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in DRIVER_TABLES:
        con.execute(f"create view {name} as select * from '{Path(sf) / (name + '.parquet')}'")
    return con


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
    if name not in ORACLES:
        assert got
        return
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in order) for r in want), key=key)


def test_entry_smoke(spark):
    assert entry.entry(spark).limit(1).count() == 1

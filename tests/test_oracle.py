"""Every registered query against its DuckDB formulation on the sf0.001 tables
(the driver repeats this at sf0.01), plus the entry smoke check."""

from __future__ import annotations

import datetime as dt
import os

import duckdb
import pytest

import __spark_entry__ as entry_mod
from tests_support import SF_SMALL
from tianguis import registry

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Spark published type -> DuckDB result type
TYPE_MAP = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
            "timestamp_ntz": "TIMESTAMP", "date": "DATE", "int": "INTEGER"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return repr(v)


def _canon(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


# The core's queries; the training-data operators have their own tests.
QUERIES = registry.queries()
ORACLE = registry.oracle_sql()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_mod.queries()) and set(ORACLE) <= set(entry_mod.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = df.collect()
    rel = duck.sql(ORACLE[name])
    dnames, dtypes = rel.columns, [str(t) for t in rel.types]
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(dnames)
    stypes = {f.name: TYPE_MAP.get(f.dataType.simpleString(), f.dataType.simpleString())
              for f in df.schema.fields}
    assert stypes == dict(zip(dnames, dtypes))
    assert _canon(df.columns, srows) == _canon(dnames, drows)


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert df.columns == ["is_late", "avg_seller_to_courier", "avg_courier_to_customer"]
    assert len(rows) >= 1

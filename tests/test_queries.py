"""Every registered query of the library against its DuckDB equivalent on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from tidemark.catalog import ORACLE_SQL, QUERIES

DATA = os.environ.get("TIDEMARK_DATA", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((repr([plain(r[i]) for i in order]) for r in rows))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    assert len(df.columns) == len(set(df.columns))
    if name in ORACLE_SQL:
        told = duck.execute(ORACLE_SQL[name])
        names = [c[0] for c in told.description]
        want = told.fetchall()
        assert sorted(df.columns) == sorted(names)
        assert rows_of(df.columns, rows) == rows_of(names, want)
    else:
        assert rows


def test_all_changes_are_ordered(spark, duck):
    found = [tuple(r) for r in QUERIES["cdc_order_all"](spark, DATA).collect()]
    assert found == duck.execute(ORACLE_SQL["cdc_order_all"]).fetchall() and len(found) > 300

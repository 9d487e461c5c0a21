"""Every query of the journal and the catalog against DuckDB over the same tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from ledgerlark.plans import catalog_queries, gate_queries, journal_queries, readmodel_queries, shelf_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()
QUERIES = {**journal_queries.QUERIES, **catalog_queries.QUERIES, **readmodel_queries.QUERIES, **gate_queries.QUERIES, **shelf_queries.QUERIES}
SQL = {**journal_queries.SQL, **catalog_queries.SQL, **readmodel_queries.SQL, **gate_queries.SQL, **shelf_queries.SQL}

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    cursor = duck.execute(SQL[name])
    assert table(found.columns, [tuple(r) for r in found.collect()]) == table([d[0] for d in cursor.description], cursor.fetchall())

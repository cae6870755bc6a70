"""Every query with SQL gives what DuckDB gives; the others give rows."""

import math

import duckdb
import pytest

from isobar.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    found, want = QUERIES[name](spark, SF), duck.sql(SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    assert dict(found.dtypes) == {k: TYPES[str(t)] for k, t in zip(want.columns, want.types, strict=True)}
    at = [want.columns.index(k) for k in columns]
    assert sorted(tuple(plain(r[k]) for k in columns) for r in found.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert not set(entry.oracle_sql()) - set(entry.queries())

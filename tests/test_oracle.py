"""Every query with SQL, value by value, against DuckDB on the same tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
# Type of a Spark column as the other engine names it.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "double": "DOUBLE",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6))
    if isinstance(value, decimal.Decimal):
        return str(value.normalize())
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return "null" if value is None else str(value)


def normal(rows, columns, order):
    place = [columns.index(c) for c in order]
    return sorted(tuple(plain(r[i]) for i in place) for r in rows)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_matches_sql(spark, duck, name):
    made = contract.queries()[name](spark, SF_DIR)
    result = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(made.columns) == sorted(columns)
    kinds = {d[0]: str(d[1]) for d in result.description}
    assert {n: TYPES[t] for n, t in made.dtypes} == kinds
    wanted = normal(result.fetchall(), columns, sorted(columns))
    got = normal([tuple(r) for r in made.collect()], made.columns, sorted(columns))
    assert len(got) == len(wanted)
    assert len(wanted) > 0
    assert got == wanted


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_runs_without_sql(spark, name):
    assert contract.queries()[name](spark, SF_DIR).count() > 0


def test_sql_only_for_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())

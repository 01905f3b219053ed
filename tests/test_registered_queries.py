"""Every registered query against its SQL counterpart in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as driver
from wattquill.plans import evaluation, meter, oracles

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return connection


OWN = meter.queries() | evaluation.queries()


def test_every_query_has_a_counterpart():
    assert OWN.keys() == oracles.oracle_sql().keys()
    assert OWN.keys() <= driver.queries().keys()


@pytest.mark.parametrize("name", sorted(OWN))
def test_same_rows(spark, duck, small, name):
    df = driver.queries()[name](spark, small)
    result = duck.execute(driver.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    kinds = {c[0]: TYPES.get(str(c[1]), str(c[1])) for c in result.description}
    assert dict(df.dtypes) == kinds
    order = sorted(columns)
    expected = [repr(tuple(row[columns.index(c)] for c in order)) for row in result.fetchall()]
    got = [repr(tuple(row)) for row in df.select(*[f"`{c}`" for c in order]).collect()]
    assert sorted(got) == sorted(expected)


def test_entry(spark):
    df = driver.entry(spark)
    assert df.count() == 150
    assert {"customer_id", "total_cost", "status"} <= set(df.columns)

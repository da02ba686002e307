"""Every registered query against its SQL, values and kinds of types."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from opsmill.plans.queries import QUERIES

KINDS = {
    "tinyint": "int32", "smallint": "int32", "int": "int32", "bigint": "int64", "double": "float",
    "string": "text", "boolean": "bool", "date": "date", "timestamp": "time", "timestamp_ntz": "time",
    "INTEGER": "int32", "BIGINT": "int64", "DOUBLE": "float", "VARCHAR": "text", "BOOLEAN": "bool",
    "DATE": "date", "TIMESTAMP": "time",
}


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.fixture(scope="module")
def oracle(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_sql_or_a_test_of_its_own():
    # Queries of the subpackage llm without SQL are tested by brute force in tests/llm.
    assert {q for q in set(entry.queries()) - set(entry.oracle_sql()) if q in QUERIES} == set()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, oracle, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    sql = entry.oracle_sql()[name]
    kinds = {row[0]: KINDS[row[1]] for row in oracle.execute(f"DESCRIBE {sql}").fetchall()}
    assert {c: KINDS[t] for c, t in df.dtypes} == kinds
    names = sorted(df.columns)
    found = [tuple(plain(row[c]) for c in names) for row in df.collect()]
    quoted = ", ".join(f'"{c}"' for c in names)
    wanted = [
        tuple(plain(v) for v in row)
        for row in oracle.execute(f"SELECT {quoted} FROM ({sql})").fetchall()
    ]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)

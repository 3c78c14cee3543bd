"""Every registered query against its SQL twin, on the smallest tables."""

from glob import glob
from os.path import basename

import duckdb
import pytest

import __spark_entry__ as entry
from domgrove.plans.oracles import ORACLES
from domgrove.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= entry.queries().keys() and ORACLES.keys() <= entry.oracle_sql().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    twin = db.execute(ORACLES[name])
    columns = [d[0] for d in twin.description]
    assert sorted(df.columns) == sorted(columns)
    rows = df.collect()
    assert sorted_rows(df.columns, rows) == sorted_rows(columns, twin.fetchall())
    assert rows, "a query without results tests nothing"


def test_entry(spark):
    assert entry.entry(spark).count() > 0

"""Every query with SQL gives the rows of that SQL."""

import glob
import math
import os

import pytest

from outcomelens.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return connection


def cell(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return f"{round(value, 6) + 0.0}"
    text = str(value)
    return text.removesuffix(" 00:00:00")


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(cell(r[i]) for i in order)) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    cursor = duck.execute(catalogue.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())


def test_queries_without_sql_run(spark):
    for name in set(catalogue.QUERIES) - set(catalogue.SQL):
        assert catalogue.QUERIES[name](spark, FOLDER).count() >= 0


def test_queries_over_empty_tables(spark, write):
    folder = write(**{os.path.basename(p)[:-8]: spark.read.parquet(p).limit(0) for p in glob.glob(f"{FOLDER}/*.parquet")})
    for name, query in catalogue.QUERIES.items():
        assert query(spark, folder).count() >= 0, name

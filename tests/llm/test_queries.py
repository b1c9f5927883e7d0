import os

import pytest

from outcomelens.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_entry_lists_them():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())


def test_round_trip_and_shapes(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    back = {r.doc_id: r.text for r in queries.p6_decoded(spark, FOLDER).collect()}
    assert back == {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    assert queries.p7_found(spark, FOLDER).columns == ["doc_id", "item_id"] and queries.p8_found(spark, FOLDER).columns == ["doc_id"]
    assert queries.p6_ids(spark, FOLDER).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert queries.p8_shares(spark, FOLDER).count() == docs.count()

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from outcomelens.operators import delivery


def brute(rows):
    """row_ids that are surplus, from (row_id, id)."""
    best, norm = {}, lambda v: None if v is None or v.strip().lower() in ("", "n/a", "null", "none", "-") else v.strip().lower()
    for i, v in rows:
        k = norm(v)
        if k is not None:
            best[k] = min(i, best.get(k, i))
    return sorted(i for i, v in rows if norm(v) is not None and best[norm(v)] != i)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), max_size=30), max_size=6))
def test_seen_ranges(batches):
    seen, taken = delivery.SeenRanges(), set()
    for batch in batches:
        numbers = np.array(batch, np.int64)
        mask = seen.accept(numbers)
        for number, ok in zip(batch, mask):
            assert ok == (number not in taken)
            taken.add(number)
        assert (seen.low <= seen.high).all() and (seen.low[1:] > seen.high[:-1] + 1).all()
        covered = {n for a, b in zip(seen.low, seen.high) for n in range(a, b + 1)}
        assert covered == taken


IDS = ["sig-00000001-001", " SIG-00000001-001\t", "sig-1-1", "sig-01-1", None, "", " n/a ", "-", "legacy-x", "LEGACY-X", "sgi-00000001-001", "sig-99999999-999", "sig-00000001-002",
       "0a8b53be-f452-ee46-2d88-16fbba17fbf5", "0A8B53BE-F452-EE46-2D88-16FBBA17FBF5", "a-123456789-123456789-123456789", "sig-00000001-001", "x" * 5000, "zz8b53be-f452-ee46-2d88-16fbba17fbf5", "0a8b53bef452--ee46-2d88-16fbba17fb-f5", "0a8b53be-f452-ee46-2d88-16fbba17fbf", "-" * 36]


def test_surplus_rows_match_brute_force(spark):
    rows = [(i, IDS[(i * 7 + i // 5) % len(IDS)]) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id bigint, name string").withColumn("key", F.lit("clash")).withColumn("producer", F.lit(1)).withColumn("number", F.lit(None).cast("int"))
    for sequences in (True, False):
        assert sorted(r.row_id for r in delivery.surplus_rows(df, "name", sequences).collect()) == brute(rows)


def test_hot_identifier_and_arrival_order(spark):
    rows = [(i, "sig-00000001-001" if i % 3 else f"sig-{i:08d}-000") for i in range(3000)][::-1]
    df = spark.createDataFrame(rows, "row_id bigint, name string").repartition(5)
    assert sorted(r.row_id for r in delivery.surplus_rows(df, "name").collect()) == brute(rows)


def test_later_batches_meet_the_ranges_of_earlier_ones(spark):
    first = spark.createDataFrame([(i, f"sig-{i:08d}-001") for i in range(10)], "row_id bigint, name string")
    second = spark.createDataFrame([(100 + i, f"sig-{i:08d}-001") for i in range(5, 15)], "row_id bigint, name string")
    ids = lambda df: delivery.parsed(df, "name").where("producer is not null")
    seen = delivery.ranges(ids(first))
    assert sorted(r.row_id for r in delivery.surplus_by_ranges(ids(second), seen).collect()) == [105, 106, 107, 108, 109]
    both = delivery.ranges(ids(second), seen).collect()
    assert {n for r in both for n in range(r.low, r.high + 1)} == {i * 1000 + 1 for i in range(15)}


def test_ranges_merge_across_blocks(spark):
    rows = spark.createDataFrame([("p", i) for i in range(10_000)] + [("q", 5), ("q", 7)], "producer string, number bigint")
    assert sorted(map(tuple, delivery.ranges(rows).collect())) == [("p", 0, 9999), ("q", 5, 5), ("q", 7, 7)]


def test_first_deliveries(spark):
    rows = [(3, "A", 1.0), (1, " a", 2.0), (2, None, 3.0), (4, None, 3.0)]
    df = spark.createDataFrame(rows, "row_id bigint, name string, v double")
    kept = delivery.first_deliveries(df, "name", ["v"]).collect()
    assert sorted((r.row_id, r.v, r.copies) for r in kept) == [(1, 2.0, 2), (2, 3.0, 1), (4, 3.0, 1)]
    assert delivery.first_deliveries(df.limit(0), "name", ["v"]).count() == 0
    assert delivery.surplus_rows(df.limit(0), "name").count() == 0

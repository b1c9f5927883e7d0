from datetime import datetime

from pyspark.sql import functions as F

from outcomelens.operators import references
from outcomelens.plans import quality

T = lambda h, d=1: datetime(2025, 1, d, h)


def test_existence_is_judged_at_the_instant_of_the_reference(spark):
    targets = spark.createDataFrame(
        [("A", T(2), T(5)), ("a ", T(8), None), ("b", T(3), T(3)), ("c", None, None), (None, T(1), None), ("d", T(1), T(9)), ("d", T(4), T(6))],
        "k string, f timestamp, t timestamp",
    )
    cases = [("a", 1, True), ("a", 2, False), (" A", 4, False), ("a", 5, True), ("a", 8, False), ("b", 3, True), ("c", 5, True), ("d", 7, False), ("d", 9, True), ("zz", 4, True)]
    rows = [(i, k, T(h)) for i, (k, h, _) in enumerate(cases)] + [(90, None, T(1)), (91, "n/a", T(1)), (92, "a", None), (93, " ", T(1))]
    refs = spark.createDataFrame(rows, "row_id bigint, ref string, received_at timestamp").withColumn("key", F.lit("clash")).withColumn("at", F.lit(1)).withColumn("block", F.lit(2))
    deltas = references.intervals_to_deltas(targets, references.identifier(F.col("k")), F.col("f"), F.col("t"))
    found = references.orphans(references.references(refs, "tab", "ref"), deltas).collect()
    assert sorted(r.row_id for r in found) == [i for i, c in enumerate(cases) if c[2]]
    assert {r.period for r in found} == {"2025-01"}


def test_hot_key_on_both_sides_and_repeats(spark):
    targets = spark.createDataFrame([("k", T(h, d), T(h + 1, d)) for d in range(1, 29) for h in (0, 6, 12)], "k string, f timestamp, t timestamp")
    rows = [(d * 100 + h, "k", T(h, d)) for d in range(1, 29) for h in range(24)]
    refs = spark.createDataFrame(rows + rows, "row_id bigint, ref string, received_at timestamp")
    found = references.orphans(references.references(refs, "t", "ref"), references.intervals_to_deltas(targets, F.col("k"), F.col("f"), F.col("t"))).collect()
    assert len(found) == 2 * 28 * 21 and all(r.row_id % 100 not in (0, 6, 12) for r in found)


def test_counts_are_maintained_from_deltas(spark):
    make = lambda rows: spark.createDataFrame(rows, "key string, refs bigint, existence bigint")
    state = references.maintain(None, make([("a", 2, 0), ("b", 1, 1), ("c", 0, 1)]))
    assert [tuple(r) for r in references.current_orphans(state).collect()] == [("a", 2)]
    state = references.maintain(state, make([("a", 0, 1), ("b", 0, -1), ("c", 0, -1)]))
    assert [tuple(r) for r in references.current_orphans(state).collect()] == [("b", 1)]
    assert {r.key for r in state.collect()} == {"a", "b"}


def test_empty_tables(spark, write):
    tables = {n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet").limit(0) for n in ("decision_audit_trail", "recommendation_accuracy", "signals")}
    folder = write(**tables)
    assert quality.p1_found(spark, folder).count() == 0 and quality.p1_report(spark, folder).count() == 0

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from outcomelens.operators import delivery
from outcomelens.streaming import live

SCHEMA = "row_id bigint, event_id string, strategy_id string, event_type string, timestamp timestamp, realized_pnl double"


def save(spark, folder, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def message(k, ident, pnl=1.0):
    return (k, ident, "s", "TRADE_OUTCOME", datetime(2026, 1, 1) + timedelta(hours=k), pnl)


def test_accepted_messages_over_batches(spark, tmp_path):
    folder = f"{tmp_path}/in"
    ids = ["m-1", "m-2", "odd", None, "M-1 ", "m-3", "odd", None, "m-2", "m-9"]
    schema = spark.createDataFrame([], SCHEMA).schema
    for part in (ids[:4], ids[4:7], ids[7:]):
        start = ids.index(part[0]) if part is ids else {4: 0, 3: 4}.get(len(part), 0) if part != ids[7:] else 7
        save(spark, folder, [[message(start + k, i) for k, i in enumerate(part)]])
        query = live.accepted_messages(spark.readStream.schema(schema).parquet(folder), "event_id", f"{tmp_path}/state", f"{tmp_path}/out", f"{tmp_path}/check").start()
        query.awaitTermination()
    whole = spark.read.schema(schema).parquet(folder)
    expected = whole.join(delivery.surplus_rows(whole, "event_id"), "row_id", "left_anti")
    assert sorted(r.row_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(r.row_id for r in expected.collect()) == [0, 1, 2, 3, 5, 7, 9]


def test_daily_amounts_equal_the_batch(spark, tmp_path):
    folder = f"{tmp_path}/in"
    rows = [message(k, f"e{k}", float(k) if k % 5 else float("nan")) for k in range(0, 24 * 40, 6)]
    save(spark, folder, [rows])
    schema = spark.createDataFrame([], SCHEMA).schema
    query = live.daily_pnl(live.read_stream(spark, folder, schema), "1 day").writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.day: (r.pnl, r.trades) for r in spark.table("days").collect()}
    frame = spark.createDataFrame(rows, SCHEMA).groupBy(F.to_date("timestamp").alias("day")).agg(F.sum(F.nanvl("realized_pnl", F.lit(0.0))).alias("pnl"), F.count("*").alias("n"))
    assert got == {r.day: (r.pnl, r.n) for r in frame.collect()}


def test_reference_counts(spark, tmp_path):
    folder, schema = f"{tmp_path}/in", "key string, refs bigint, existence bigint"
    for rows in ([("a", 1, 0), ("b", 1, 1)], [("a", 0, 1), ("b", 0, -1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        live.reference_counts(spark.readStream.schema(schema).parquet(folder), f"{tmp_path}/state", f"{tmp_path}/check").start().awaitTermination()
    assert {(r.key, r.refs, r.existence) for r in spark.read.parquet(f"{tmp_path}/state/1").collect()} == {("a", 1, 1), ("b", 1, 0)}


def test_first_deliveries_keep_rows_without_identifier(spark, tmp_path):
    from outcomelens.streaming import live as twins

    rows = spark.sql("select * from values (1, 'a'), (2, 'A '), (3, null), (4, 'n/a'), (5, null), (6, 'b') t(row_id, event_id)")
    rows = rows.selectExpr("*", "timestamp_ntz'2025-01-01 00:00:00' as timestamp")
    rows.write.parquet(f"{tmp_path}/in")
    stream = twins.first_deliveries(twins.read_stream(spark, f"{tmp_path}/in", rows.schema))
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(60)
    found = sorted(r.row_id for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert found[-4:] == [3, 4, 5, 6] and len(found) == 5

"""Structured Streaming twins of the batch operators.

Event time must be a TIMESTAMP (not NTZ) for watermarks; the readers cast it. Each twin run with availableNow over the same
files ends with the batch result, except what the watermarks of daily_pnl and first_deliveries lose (README.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from outcomelens.functions.exprs import finite, money
from outcomelens.functions.identifiers import identifier
from outcomelens.operators import delivery, references
from outcomelens.operators.events import is_trade
from outcomelens.sources.files import exists


def read_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files of a folder as they arrive, with event time `at`."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("at", F.col("timestamp").cast("timestamp"))


def daily_pnl(events: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Tumbling days of settled amounts per strategy; a day is final once the watermark has passed it."""
    rows = events.where(is_trade()).withColumn("pnl", finite(F.col("realized_pnl"))).withWatermark("at", lateness)
    days = rows.groupBy("strategy_id", F.window("at", "1 day").alias("w")).agg(money(F.col("pnl")).alias("pnl"), F.count("*").alias("trades"))
    return days.select("strategy_id", F.to_date("w.start").alias("day"), "pnl", "trades")


def first_deliveries(events: DataFrame, lateness: str = "30 days") -> DataFrame:
    """First wins within the watermark: state is dropped for identifiers older than `lateness`. Rows without identifier are
    all kept."""
    keyed = events.withColumn("key", identifier(F.col("event_id")))
    named = keyed.where("key is not null").withWatermark("at", lateness).dropDuplicatesWithinWatermark(["key"])
    return named.unionByName(keyed.where("key is null"))


def accepted_messages(messages: DataFrame, id_column: str, state: str, out: str, checkpoint: str) -> DataStreamWriter:
    """Exactly one row of every identifier over all batches: seen ranges per producer (and keys of malformed identifiers)
    are kept as tables below `state`, one version a batch, so a batch that is run again finds the state it began with."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        ids = delivery.parsed(rows, id_column).persist()
        before, now = f"{state}/{number - 1}", f"{state}/{number}"
        old = exists(spark, f"{before}/ranges")
        seen = spark.read.parquet(f"{before}/ranges") if old else None
        sequences, others = ids.where("producer is not null"), ids.where("producer is null")
        surplus = delivery.surplus_by_ranges(sequences, seen)
        known = spark.read.parquet(f"{before}/keys") if old else spark.createDataFrame([], "id string")
        fresh = others.join(known, "id", "left_anti")
        kept = sequences.select("row_id").join(surplus, "row_id", "left_anti").unionByName(fresh.groupBy("id").agg(F.min("row_id").alias("row_id")).select("row_id"))
        unnamed = rows.where(identifier(F.col(id_column)).isNull())
        rows.join(kept, "row_id", "left_semi").unionByName(unnamed).write.mode("overwrite").parquet(f"{out}/batch={number}")
        delivery.ranges(sequences, seen).write.mode("overwrite").parquet(f"{now}/ranges")
        known.unionByName(fresh.select("id").distinct()).write.mode("overwrite").parquet(f"{now}/keys")
        ids.unpersist()

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def reference_counts(changes: DataFrame, state: str, checkpoint: str) -> DataStreamWriter:
    """Signed reference and existence counts per key, kept as one table version a batch; changes: (key, refs, existence)."""

    def batch(rows: DataFrame, number: int) -> None:
        spark, before = rows.sparkSession, f"{state}/{number - 1}"
        old = spark.read.parquet(before) if exists(spark, before) else None
        references.maintain(old, rows).write.mode("overwrite").parquet(f"{state}/{number}")

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def stale_sources(events: DataFrame, hours: int = 24) -> DataFrame:
    """Last event time per source; a consumer compares it with its clock (see sources.files.freshness)."""
    return events.groupBy("source_bot").agg(F.max("at").alias("last_at"))

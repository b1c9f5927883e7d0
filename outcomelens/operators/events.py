"""The tactical event table: one row per event, validated, in order of arrival (seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from outcomelens.functions.exprs import finite, label
from outcomelens.operators import delivery
from outcomelens.schema import TRADE_OUTCOME

METADATA = "symbol string, setup_type string, data_is_real boolean, expected_rr double, pnl_pct double"


def invalid_reason(source: Column, kind: Column, strategy: Column, ts: Column, score: Column) -> Column:
    """First rule an event breaks; null for a valid one. A score must be null or in [0, 1], so NaN is invalid."""
    missing = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when(missing(source), "source_bot_missing")
        .when(missing(kind), "event_type_missing")
        .when(missing(strategy), "strategy_id_missing")
        .when(ts.isNull(), "timestamp_missing")
        .when(score.isNotNull() & ~((score >= 0) & (score <= 1) & ~F.isnan(score)), "score_out_of_range")
    )


def raw_events(rows: DataFrame) -> DataFrame:
    """First delivery of every event, with the columns promoted from its metadata and the rule it breaks, if any."""
    columns = ["event_id", "source_bot", "event_type", "strategy_id", "timestamp", "regime", "score", "realized_pnl", "outcome", "metadata"]
    once = delivery.first_deliveries(rows, "event_id", columns, prunable=True)
    meta = F.from_json("metadata", METADATA)
    broken = invalid_reason(F.col("source_bot"), F.col("event_type"), F.col("strategy_id"), F.col("timestamp"), F.col("score"))
    return once.withColumn("m", meta).select(
        F.col("row_id").alias("seq"), "event_id", F.col("timestamp").alias("ts"), "source_bot", "event_type", "strategy_id", "regime", "score",
        F.col("m.expected_rr").alias("expected_rr"), finite(F.col("realized_pnl")).alias("pnl"), "outcome", label(F.col("m.symbol")).alias("symbol"),
        F.col("m.setup_type").alias("setup_type"), F.coalesce(F.col("m.data_is_real"), F.lit(False)).alias("data_is_real"), "metadata", broken.alias("invalid"),
    )


def tactical_events(rows: DataFrame) -> DataFrame:
    """Valid events only; what is left out is counted by validation()."""
    return raw_events(rows).where("invalid is null").drop("invalid")


def validation(rows: DataFrame) -> DataFrame:
    """Events per broken rule, 'valid' for the rest."""
    return raw_events(rows).groupBy(F.coalesce("invalid", F.lit("valid")).alias("status")).agg(F.count("*").alias("events"))


def is_trade() -> Column:
    return F.col("event_type") == TRADE_OUTCOME

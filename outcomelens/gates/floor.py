"""The statistical floor: evidence is strong only if no rule refuses it. Every rule that refuses is listed, in order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from outcomelens.functions.exprs import finite, label
from outcomelens.operators import performance
from outcomelens.schema import FLOOR_REGIMES


@dataclass(frozen=True)
class FloorRules:
    sample: int = 30
    confidence: float = 0.70
    win_rate: float = 0.55
    edge: float = 0.02
    hours: int = 168


def _unit(value: Column) -> Column:
    return F.when((value >= 0) & (value <= 1) & ~F.isnan(value), value)


OVERRIDES = ("sample_size", "confidence", "win_rate", "edge", "data_is_real", "produced_at", "fresh_until", "regime", "regime_verified", "exposure_increasing")


def evidence_from_events(events: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """The evidence of every strategy with events: trades, mean score, win rate, last event, most frequent regime. overrides:
    (strategy_id and any of OVERRIDES) replace what they hold. Edge and expiry are not in events; exposure counts as rising."""
    last = events.groupBy("strategy_id").agg(F.max("ts").cast("timestamp").alias("produced_at"), F.bool_or("data_is_real").alias("data_is_real"))
    stats = performance.strategy_stats(events).select(F.col("strategy_id"), F.col("trade_outcomes").alias("sample_size"), F.col("avg_score").alias("confidence"), "win_rate")
    top = performance.strategy_top_regime(events).select("strategy_id", F.col("top_regime").alias("regime"))
    rows = stats.join(last, "strategy_id").join(top, "strategy_id", "left")
    rows = rows.withColumns({"edge": F.lit(None).cast("double"), "fresh_until": F.lit(None).cast("timestamp"), "regime_verified": F.col("regime").isNotNull(), "exposure_increasing": F.lit(True)})
    if overrides is None:
        return rows
    given = [c for c in OVERRIDES if c in overrides.columns]
    joined = rows.join(overrides.select("strategy_id", *[F.col(c).alias(f"given_{c}") for c in given]), "strategy_id", "left")
    return joined.withColumns({c: F.coalesce(f"given_{c}", c) for c in given}).drop(*[f"given_{c}" for c in given])


def statistical_floor(evidence: DataFrame, as_of: Column, rules: FloorRules = FloorRules()) -> DataFrame:
    """evidence: subject, sample_size, confidence, win_rate, edge, data_is_real, produced_at, fresh_until, regime,
    regime_verified, exposure_increasing. Adds refusals, warnings (arrays), approved and strength. Null evidence refuses."""
    sample, confidence, rate, edge = F.col("sample_size"), _unit(F.col("confidence")), _unit(F.col("win_rate")), finite(F.col("edge"))
    produced, until = F.col("produced_at"), F.col("fresh_until")
    hours = F.timestamp_diff("MICROSECOND", produced, as_of) / F.lit(3.6e9)
    dated = produced.isNotNull() & (produced <= as_of)
    regime = F.coalesce(F.nullif(label(F.col("regime")), F.lit("")), F.lit("UNKNOWN"))
    unknown = ~regime.isin(*FLOOR_REGIMES)
    exposed = F.coalesce("exposure_increasing", F.lit(False))
    refusals = (
        (sample.isNull() | (sample < 0), "sample_size_invalid"), (sample.between(0, rules.sample - 1), "sample_size_below_floor"),
        (confidence.isNull(), "confidence_invalid"), (confidence < rules.confidence, "confidence_below_floor"),
        (F.col("win_rate").isNotNull() & rate.isNull(), "win_rate_invalid"), (F.col("edge").isNotNull() & edge.isNull(), "edge_invalid"),
        (rate.isNull() & edge.isNull(), "edge_or_win_rate_missing"), (rate < rules.win_rate, "win_rate_below_floor"), (edge < rules.edge, "edge_below_floor"),
        (~F.coalesce("data_is_real", F.lit(False)), "data_not_real"), (produced.isNull(), "produced_at_missing_or_invalid"), (produced > as_of, "produced_at_future"),
        (dated & ((hours > rules.hours) | (until < as_of)), "evidence_stale"), (exposed & unknown, "regime_unknown_or_unsupported"),
        (exposed & ~F.coalesce("regime_verified", F.lit(False)), "regime_not_verified"),
    )
    listed = F.array_compact(F.array(*[F.when(broken, name) for broken, name in refusals]))
    warnings = F.array_compact(F.array(F.when(~exposed & unknown, "regime_diagnostic_only")))
    approved = F.size("refusals") == 0
    judged = evidence.withColumn("refusals", listed).withColumn("warnings", warnings)
    return judged.withColumn("approved", approved).withColumn("strength", F.when(approved, "STRONG").otherwise("DIAGNOSTIC_ONLY"))

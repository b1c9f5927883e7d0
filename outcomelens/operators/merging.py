"""Merging sources: union in order, first- or last-wins deduplication, and the mappings of records to events.

Winners are found by an aggregate (partial before the shuffle), so a key may hold any share of the rows. Rows whose key
has a missing part are never merged where the operator says so; null keys otherwise fall back to the row itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from outcomelens.functions.exprs import finite, label, mapped, r6
from outcomelens.functions.identifiers import identifier
from outcomelens.schema import AUDIT_REGIMES, BREAKEVEN, EXPORT_REGIMES, LOSS, PENDING, RECOMMENDATION, REJECTION, TRADE_OUTCOME, WIN


def _winners(rows: DataFrame, keys: list[str], order: str, last: bool) -> DataFrame:
    others = [c for c in rows.columns if c not in (*keys, order)]
    pick = (F.max if last else F.min)(F.struct(order, *others)).alias("_kept")
    kept = rows.groupBy(*keys).agg(pick)
    return kept.select(*[f"_kept.{c}" if c not in keys else c for c in rows.columns])


def dedup_first_wins(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The earliest row per key; missing key parts count as one value."""
    return _winners(rows, keys, order, last=False)


def dedup_last_wins(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The latest row per key; rows that miss a part of the key all stay."""
    whole = F.lit(True)
    for key in keys:
        whole = whole & F.col(key).isNotNull()
    return _winners(rows.where(whole), keys, order, last=True).unionByName(rows.where(~whole))


def merge_key(source: Column, signal: Column, event: Column) -> Column:
    """source:signal where there is a signal, else the event's own identifier."""
    return F.when(F.coalesce(signal, F.lit("")) != "", F.concat_ws(":", source, signal)).otherwise(event)


def union_in_order(*sources: DataFrame) -> DataFrame:
    """All rows, by source priority and then the source's own order, as (priority, seq, ...)."""
    out = None
    for priority, rows in enumerate(sources):
        ranked = rows.withColumn("priority", F.lit(priority))
        out = ranked if out is None else out.unionByName(ranked, allowMissingColumns=True)
    return out


def merge_sources(*sources: DataFrame) -> DataFrame:
    """(priority, seq, source_bot, key) that survive first-wins over all sources."""
    return dedup_first_wins(union_in_order(*sources).select("key", F.struct("priority", "seq").alias("at"), "source_bot"), ["key"], "at").select("at.priority", "at.seq", "source_bot", "key")


def merge_stats(*sources: DataFrame) -> DataFrame:
    """Per source: rows before and after the merge."""
    every, kept = union_in_order(*sources), merge_sources(*sources)
    before = every.groupBy("source_bot").agg(F.count("*").alias("loaded"))
    after = kept.groupBy("source_bot").agg(F.count("*").alias("kept"))
    joined = before.join(after, "source_bot", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return joined.withColumn("duplicates", F.col("loaded") - F.col("kept"))


def audit_events(audit: DataFrame, accuracy: DataFrame) -> DataFrame:
    """Decisions as events, with the outcome reported last for their signal. Decisions without strategy are left out; an
    invalid or missing risk-reward result gives no expected_rr."""
    known = accuracy.select(identifier(F.col("signal_id")).alias("signal"), "row_id", "outcome_pnl", "outcome_win").where("signal is not null")
    latest = _winners(known, ["signal"], "row_id", last=True).select("signal", F.lit(True).alias("reported"), finite(F.col("outcome_pnl")).alias("pnl"), "outcome_win")
    rows = audit.where("strategy_id <> ''").withColumn("signal", identifier(F.col("signal_id"))).join(latest, "signal", "left")
    decision = label(F.col("final_decision"))
    kind = (
        F.when((decision == "ACCEPTED") & F.col("pnl").isNotNull(), TRADE_OUTCOME)
        .when(decision.isin("REJECTED", "SKIPPED"), REJECTION)
        .otherwise(RECOMMENDATION)
    )
    by_pnl = F.when(F.col("pnl") > 0, WIN).when(F.col("pnl").isNotNull(), LOSS)
    outcome = F.when(F.col("outcome_win"), WIN).when(~F.col("outcome_win"), LOSS).otherwise(by_pnl)
    outcome = F.when(F.col("reported").isNull(), F.when(kind == RECOMMENDATION, PENDING)).otherwise(outcome)
    rr = F.when(F.col("risk_reward_result.is_valid"), finite(F.col("risk_reward_result.risk_reward_ratio")))
    return rows.select(
        "row_id", "signal", "strategy_id", kind.alias("event_type"), mapped(F.col("regime"), AUDIT_REGIMES, F.lit(None).cast("string")).alias("regime"),
        finite(F.col("score")).alias("score"), r6(rr).alias("expected_rr"), "pnl", outcome.alias("outcome"),
    )


def outcome_of(pnl: Column) -> Column:
    return F.when(pnl.isNull(), PENDING).when(pnl > 0, WIN).when(pnl < 0, LOSS).otherwise(BREAKEVEN)


def regime_events(exports: DataFrame) -> DataFrame:
    """Regime exports as events: known regimes mapped, confidence cut to 0..100; a score only for real data."""
    regime = F.coalesce(F.nullif(label(F.col("market_regime")), F.lit("")), F.lit("UNKNOWN"))
    regime = F.when(regime.isin(*EXPORT_REGIMES), regime).otherwise("UNKNOWN")
    confidence = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("confidence", F.lit(0))))
    score = F.when(F.coalesce("data_is_real", F.lit(False)), F.round(confidence / 100, 4)).otherwise(0.0)
    return exports.select("row_id", F.concat(F.lit("regime_"), F.lower(regime)).alias("strategy_id"), mapped(regime, EXPORT_REGIMES, F.lit("UNKNOWN")).alias("regime"), confidence.cast("int").alias("confidence"), score.alias("score"))

"""Aggregates by strategy, regime, symbol and score. Every denominator is stated where it is used; nulls never count as
values, empty input gives empty groups, ties in rankings go to what arrived first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from outcomelens.functions.exprs import mean, money, or_unknown, r6, ratio
from outcomelens.operators.events import is_trade
from outcomelens.schema import BREAKEVEN, LOSS, RECOMMENDATION, REJECTION, WIN

#: Confidence ranges, the upper edge excluded.
CONFIDENCE = (("0.00-0.50", 0.0, 0.5), ("0.50-0.60", 0.5, 0.6), ("0.60-0.70", 0.6, 0.7), ("0.70-0.80", 0.7, 0.8), ("0.80-1.00", 0.8, 1.01))


def _count(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def _traded(outcome: str) -> Column:
    return is_trade() & (F.col("outcome") == outcome)


def data_quality(events: DataFrame) -> DataFrame:
    missing = [_count(F.col(c).isNull(), f"missing_{n}") for c, n in (("regime", "regime"), ("score", "score"), ("pnl", "pnl"), ("outcome", "outcome"))]
    return events.agg(F.count("*").alias("total_events"), *missing)


def counts_by(events: DataFrame, *columns: str) -> DataFrame:
    return events.groupBy(*columns).agg(F.count("*").alias("events"))


def strategy_stats(events: DataFrame) -> DataFrame:
    """Per strategy; win_rate and avg_realized_pnl over all its trade outcomes, averages of scores over all its events."""
    stats = events.groupBy("strategy_id").agg(
        F.count("*").alias("total_events"), _count(is_trade(), "trade_outcomes"), _count(_traded(WIN), "wins"), _count(_traded(LOSS), "losses"),
        _count(_traded(BREAKEVEN), "breakevens"), money(F.when(is_trade(), F.col("pnl"))).alias("total_pnl"), mean(F.col("score")).alias("avg_score"),
        mean(F.col("expected_rr")).alias("avg_expected_rr"), F.min("seq").alias("first_seq"),
    )
    return stats.withColumn("win_rate", r6(ratio(F.col("wins"), F.col("trade_outcomes")))).withColumn("avg_realized_pnl", r6(ratio(F.col("total_pnl"), F.col("trade_outcomes"))))


def regime_stats(events: DataFrame) -> DataFrame:
    """Per regime, a missing one as UNKNOWN; denominators as in strategy_stats."""
    stats = events.groupBy(or_unknown(F.col("regime")).alias("regime")).agg(
        F.count("*").alias("total_events"), _count(is_trade(), "trade_outcomes"), _count(_traded(WIN), "wins"), _count(_traded(LOSS), "losses"),
        money(F.when(is_trade(), F.col("pnl"))).alias("total_pnl"), F.min("seq").alias("first_seq"),
    )
    return stats.withColumn("win_rate", r6(ratio(F.col("wins"), F.col("trade_outcomes")))).withColumn("avg_pnl", r6(ratio(F.col("total_pnl"), F.col("trade_outcomes"))))


def strategy_regime_counts(events: DataFrame) -> DataFrame:
    """Named regimes only."""
    return counts_by(events.where("regime <> ''"), "strategy_id", "regime")


def regime_strategy_counts(events: DataFrame) -> DataFrame:
    return counts_by(events.withColumn("regime", or_unknown(F.col("regime"))), "regime", "strategy_id")


def rejection_stats(events: DataFrame) -> DataFrame:
    totals = events.agg(_count(F.col("event_type") == REJECTION, "rejections"), _count(is_trade(), "trade_outcomes"))
    return totals.withColumn("rejection_rate", r6(ratio(F.col("rejections"), F.col("rejections") + F.col("trade_outcomes"))))


def rejections_by(events: DataFrame, column: str) -> DataFrame:
    key = or_unknown(F.col(column)) if column == "regime" else F.col(column)
    return events.where(F.col("event_type") == REJECTION).groupBy(key.alias(column)).agg(F.count("*").alias("rejections"))


def recommendation_quality(events: DataFrame) -> DataFrame:
    """Win rates of trades scored from 0.7 and below 0.5; every outcome counts in the denominators."""
    scored = is_trade() & F.col("score").isNotNull()
    won = F.col("outcome") == WIN
    high, low = scored & (F.col("score") >= 0.7), scored & (F.col("score") < 0.5)
    totals = events.agg(
        _count(F.col("event_type") == RECOMMENDATION, "recommendations"), _count(scored, "scored_outcomes"), mean(F.when(scored, F.col("score"))).alias("avg_score"),
        _count(high, "high_count"), _count(high & won, "high_wins"), _count(low, "low_count"), _count(low & won, "low_wins"),
    )
    return totals.withColumn("high_score_win_rate", r6(ratio(F.col("high_wins"), F.col("high_count")))).withColumn("low_score_win_rate", r6(ratio(F.col("low_wins"), F.col("low_count"))))


def score_vs_outcome(events: DataFrame) -> DataFrame:
    return events.where(is_trade() & F.col("score").isNotNull()).select("seq", "strategy_id", "score", "outcome", "pnl")


def symbol_concentration(events: DataFrame) -> DataFrame:
    """Per named symbol; total_pnl is null where no trade of it has an amount."""
    pnl = F.when(is_trade(), F.col("pnl"))
    return events.where("symbol <> ''").groupBy("symbol").agg(
        F.count("*").alias("events"), _count(is_trade(), "trade_outcomes"), _count(F.col("event_type") == REJECTION, "rejections"),
        F.when(F.count(pnl) > 0, money(pnl)).alias("total_pnl"), F.min("seq").alias("first_seq"),
    )


def top_symbols(events: DataFrame, n: int = 15) -> DataFrame:
    """The n symbols with most events (a report of fixed length)."""
    return symbol_concentration(events).orderBy(F.desc("events"), "first_seq").limit(n)


def confidence_distribution(events: DataFrame) -> DataFrame:
    """Five fixed score ranges over all events, empty ones included; win_rate over wins and losses."""
    spark = events.sparkSession
    score, bucket = F.col("score"), F.lit(None).cast("string")
    for name, low, high in CONFIDENCE:
        bucket = F.when((score >= low) & (score < high), name).otherwise(bucket)
    found = events.where("score is not null").groupBy(bucket.alias("bucket")).agg(
        F.count("*").alias("events"), _count(_traded(WIN), "wins"), _count(_traded(LOSS), "losses")
    )
    every = spark.createDataFrame([(name,) for name, _, _ in CONFIDENCE], "bucket string")
    filled = every.join(found, "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("events", "wins", "losses")])
    return filled.withColumn("win_rate", r6(ratio(F.col("wins"), F.col("wins") + F.col("losses"))))


def candidate_ranking(events: DataFrame, n: int | None = None) -> DataFrame:
    """Per symbol and strategy: composite = average score (0.5 if none) times win rate (0.5 if none); avg_pnl over
    amounts that are there. n: only the best n (a report of fixed length)."""
    pnl = F.when(is_trade(), F.col("pnl"))
    stats = events.where("symbol <> ''").groupBy("symbol", "strategy_id").agg(
        F.count("*").alias("events"), _count(is_trade(), "trade_outcomes"), _count(_traded(WIN), "wins"),
        F.when(F.count(pnl) > 0, r6(ratio(money(pnl), F.count(pnl)))).alias("avg_pnl"), mean(F.col("score")).alias("avg_score"), F.min("seq").alias("first_seq"),
    )
    ranked = stats.withColumn("win_rate", r6(ratio(F.col("wins"), F.col("trade_outcomes"))))
    composite = r6(F.coalesce("avg_score", F.lit(0.5)) * F.coalesce("win_rate", F.lit(0.5)), 9)
    ranked = ranked.withColumn("composite", composite)
    return ranked if n is None else ranked.orderBy(F.desc("composite"), "first_seq").limit(n)


def _arg_max(events: DataFrame, key: str, other: str) -> DataFrame:
    counted = events.groupBy(key, other).agg(F.count("*").alias("events"), F.min("seq").alias("first_seq"))
    best = F.max(F.struct("events", -F.col("first_seq"), other))
    return counted.groupBy(key).agg(best.alias("best")).select(key, F.col(f"best.{other}").alias(f"top_{other}"), F.col("best.events").alias("events"))


def strategy_top_regime(events: DataFrame) -> DataFrame:
    return _arg_max(events.where("regime <> ''"), "strategy_id", "regime")


def regime_top_strategy(events: DataFrame) -> DataFrame:
    return _arg_max(events.withColumn("regime", or_unknown(F.col("regime"))), "regime", "strategy_id")


def executive_summary(events: DataFrame, floor: int = 30) -> DataFrame:
    totals = events.agg(
        F.count("*").alias("total_events"), F.countDistinct("strategy_id").alias("strategies"), F.countDistinct(or_unknown(F.col("regime"))).alias("regimes"),
        _count(is_trade(), "trades"), _count(_traded(WIN), "wins"), money(F.when(is_trade(), F.col("pnl"))).alias("total_pnl"),
    )
    return totals.withColumn("win_rate", r6(ratio(F.col("wins"), F.col("trades")))).withColumn("confidence", F.when(F.col("trades") < floor, "DIAGNOSTIC_ONLY").otherwise("OK"))


def baseline_snapshot(events: DataFrame) -> DataFrame:
    """The rates a later run compares itself with, in long form: one row per metric and subject."""
    strategies, regimes = strategy_stats(events), regime_stats(events)
    overall = executive_summary(events).withColumn("avg_pnl", r6(ratio(F.col("total_pnl"), F.col("trades"))))
    long = lambda df, metric, subject, value: df.select(F.lit(metric).alias("metric"), subject.alias("subject"), value.cast("double").alias("value"))
    parts = [long(overall, m, F.lit(""), F.col(c)) for m, c in (("total_events", "total_events"), ("overall_win_rate", "win_rate"), ("avg_pnl", "avg_pnl"))]
    parts += [long(strategies, "strategy_win_rate", F.col("strategy_id"), F.col("win_rate")), long(regimes, "regime_win_rate", F.col("regime"), F.col("win_rate"))]
    parts += [long(regimes, "regime_events", F.col("regime"), F.col("total_events"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def result_snapshot(events: DataFrame) -> DataFrame:
    """One row: the strategy with the best win rate among those with trades, the regime with most trades (even none)."""
    strategies = strategy_stats(events).where("trade_outcomes > 0").agg(F.max_by("strategy_id", F.struct("win_rate", -F.col("first_seq"))).alias("top_strategy"))
    regimes = regime_stats(events).agg(F.max_by("regime", F.struct("trade_outcomes", -F.col("first_seq"))).alias("top_regime_fit"))
    summary = executive_summary(events).select(F.col("total_events").alias("event_count"), "strategies", "regimes")
    quality = recommendation_quality(events).select(F.col("avg_score").alias("recommendation_quality_score"))
    status = F.when(F.col("event_count") == 0, "EMPTY").otherwise("OK")
    one_row = [df.withColumn("k", F.lit(1)) for df in (summary, strategies, regimes, quality)]
    return one_row[0].join(one_row[1], "k").join(one_row[2], "k").join(one_row[3], "k").drop("k").withColumn("status", status)

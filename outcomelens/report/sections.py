"""The sections of the reports, from events, bars and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from outcomelens.gates import floor
from outcomelens.operators import backtest, bars, correlation, outcomes, performance, sequences
from outcomelens.report.render import Table, fetch
from outcomelens.schema import REGIMES

#: Wording of the observations.
WORDING = {
    "missing_outcome": "{value:.0%} of the events have no outcome.",
    "weak_strategy": "Strategy {subject} wins {value:.0%} of its trades.",
    "strong_strategy": "Strategy {subject} wins {value:.0%} of its trades, which is strong.",
    "score_inversion": "High scores win less often than low ones.",
    "calibration": "The lowest scores win more often than the middle ones.",
    "regime_bias": "Regime {subject} is traded {value:.1f} times as often as expected.",
    "edge_erosion": "Strategy {subject} lately wins {value:.0%} less than before.",
    "loss_streak": "Strategy {subject} has lost {value:.0f} times in a row.",
    "rejection_rate": "{value:.0%} of the actionable signals are rejected.",
}


def event_sections(events: DataFrame) -> list[Table]:
    first, desc = "first_seq", F.desc
    said = fetch("Observation values", sequences.observations(events), ["ordinal", "rule", "subject"])
    lines = [(WORDING[rule].format(subject=subject, value=value if value is not None else float("nan")),) for _, rule, subject, value in said.rows]
    return [
        fetch("Executive summary", performance.executive_summary(events)),
        fetch("Strategies", performance.strategy_stats(events), [desc("trade_outcomes"), first]),
        fetch("Regimes", performance.regime_stats(events), [desc("total_events"), first]),
        fetch("Recommendation quality", performance.recommendation_quality(events)),
        fetch("Rejections", performance.rejections_by(events, "strategy_id"), [desc("rejections"), "strategy_id"]),
        fetch("Data quality", performance.data_quality(events)),
        fetch("Symbols", performance.top_symbols(events), [desc("events"), first]),
        fetch("Confidence", performance.confidence_distribution(events), ["bucket"]),
        fetch("Candidates", performance.candidate_ranking(events, 10), [desc("composite"), first]),
        fetch("Rolling win rates", sequences.rolling_win_rates(events), ["window"]),
        fetch("Streaks", sequences.streak_analysis(events), [desc("current_loss_streak"), "strategy_id"]),
        fetch("Edge erosion", sequences.edge_erosion(events), [desc("drop"), "strategy_id"]),
        fetch("Regime bias", sequences.regime_bias(events), ["regime"]),
        fetch("Score calibration", sequences.score_calibration(events), ["bin"]),
        fetch("Amounts", outcomes.pnl_distribution(events)),
        fetch("Regime and strategy", outcomes.regime_strategy_fit(events), ["regime", "strategy_id"]),
        Table("Observations", ["observation"], lines, said.more),
    ]


def floor_sections(events: DataFrame, as_of: Column, overrides: DataFrame | None = None) -> list[Table]:
    """The statistical floor checked again on what the report shows: every strategy with the rules that refuse it."""
    judged = floor.statistical_floor(floor.evidence_from_events(events, overrides), as_of)
    shown = judged.select("strategy_id", "sample_size", "confidence", "win_rate", "approved", "strength", F.array_join("refusals", "; ").alias("refusals"))
    return [fetch("Statistical floor", shown, [F.desc("approved"), F.desc("sample_size"), "strategy_id"])]


def fit_sections(events: DataFrame, floor: int = 30) -> list[Table]:
    """The regime and strategy fit as a list and as a grid; withheld rates stay empty, absent cells show a dash."""
    grid = outcomes.regime_strategy_grid(events, floor)
    cell = F.when(F.col("cell") == "shown", F.format_string("%.2f", "win_rate")).otherwise(F.col("cell"))
    wide = grid.groupBy("strategy_id").pivot("regime", list(REGIMES)).agg(F.first(cell))
    return [fetch("Fit", outcomes.regime_strategy_fit(events, floor), ["regime", "strategy_id"]), fetch("Grid", wide, ["strategy_id"])]


def correlation_sections(streams: DataFrame, a: str, b: str) -> list[Table]:
    """Correlation of two streams with what was left out, and its rolling variant."""
    return [
        fetch("Correlation", correlation.strategy_correlation(streams, a, b)),
        fetch("Left out", correlation.correlation_exclusions(streams), ["stream", "reason"]),
        fetch("Rolling correlation", correlation.rolling_correlation(streams, a, b), [F.desc("day")], 20),
    ]


def soak_sections(rows: DataFrame, signals: DataFrame, rules: backtest.BacktestRules = backtest.BacktestRules()) -> list[Table]:
    """Backtest of synthetic setups, ranked by expectancy, and the verdict of the floor on each. The trades are synthetic, so no
    setup is real; the soak asks what the floor says of the statistics alone."""
    ranked = backtest.setup_expectancy(backtest.backtest_trades(rows, signals, rules))
    evidence = ranked.select(
        F.col("setup").alias("subject"), F.col("trades").alias("sample_size"), F.col("win_rate").alias("confidence"), "win_rate", (F.col("avg_return_pct") / 100).alias("edge"), F.lit(True).alias("data_is_real"),
        F.current_timestamp().alias("produced_at"), F.lit(None).cast("timestamp").alias("fresh_until"), F.lit(None).cast("string").alias("regime"), F.lit(False).alias("regime_verified"), F.lit(False).alias("exposure_increasing"),
    )
    judged = floor.statistical_floor(evidence, F.current_timestamp()).select("subject", "sample_size", "win_rate", F.round("edge", 4).alias("edge"), "strength", F.array_join("refusals", "; ").alias("refusals"))
    return [fetch("Expectancy", ranked, ["rank"]), fetch("Floor", judged, [F.desc("edge"), "subject"])]


def dashboard_sections(events: DataFrame) -> list[Table]:
    wanted = {"Executive summary", "Regimes", "Data quality", "Observations"}
    flags = fetch("Strategies", sequences.strategy_dashboard(events), [F.desc("trade_outcomes"), "strategy_id"])
    return [flags, *[t for t in event_sections(events) if t.title in wanted]]


def scan_sections(rows: DataFrame) -> list[Table]:
    valid = bars.valid_bars(rows, strict=True)
    scan = bars.pattern_scan(valid)
    return [
        fetch("Bar errors", bars.bar_validation(rows).where("error <> ''"), ["symbol", "error"]),
        fetch("Detected", scan.where("detected"), ["symbol", "pattern"]),
        fetch("Not detected", scan.where("not detected"), ["symbol", "pattern"]),
        fetch("Evidence", bars.pattern_evidence(valid), ["symbol", "pattern", "measure"]),
        fetch("Indicators", bars.indicator_report(valid), ["symbol"]),
    ]


def outcome_sections(records: DataFrame, floor: int = 30) -> list[Table]:
    summary = outcomes.setup_outcome_summary(records, floor)
    return [fetch("Setups", summary, ["setup"]), fetch("Unrecognised labels", outcomes.unrecognised_labels(records), ["first_seq"])]


def backtest_sections(rows: DataFrame, signals: DataFrame, rules: backtest.BacktestRules) -> list[Table]:
    """Bars with any error fail their whole symbol."""
    valid = bars.valid_bars(rows, strict=True)
    trades = backtest.backtest_trades(valid, signals, rules)
    return [
        fetch("Bar errors", bars.bar_validation(rows).where("error <> ''"), ["symbol", "error"]),
        fetch("Skipped", backtest.backtest_skipped(valid, signals), ["reason"]),
        fetch("Trades", trades, ["symbol", "signal_date"]),
        fetch("Summary", backtest.backtest_summary(trades), ["symbol"]),
        fetch("By setup", backtest.backtest_by_setup(trades), ["symbol", "setup"]),
    ]

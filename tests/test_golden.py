"""Hand-computed values."""

from datetime import date, datetime, timedelta

import pytest

from outcomelens.functions.exprs import setup_label, setup_recognised
from outcomelens.gates import floor, provenance, trend
from outcomelens.operators import backtest, bars, correlation, outcomes, performance, sequences
from pyspark.sql import functions as F

DAY = date(2024, 1, 1)
EVENT = "seq bigint, ts timestamp, source_bot string, event_type string, strategy_id string, regime string, score double, expected_rr double, pnl double, outcome string, symbol string, setup_type string, data_is_real boolean, metadata string"


def bar_frame(spark, rows, symbol="S"):
    return spark.createDataFrame([(i, symbol, DAY + timedelta(days=i), *map(float, r[:4]), r[4] if len(r) > 4 else None) for i, r in enumerate(rows)],
                                 "row_id int, symbol string, date date, open double, high double, low double, close double, volume bigint")


def closes(spark, values, volumes=None):
    return bar_frame(spark, [(v, v, v, v, volumes[i] if volumes else None) for i, v in enumerate(values)])


def last(df):
    return df.orderBy(F.desc("date")).first()


def event(k, **values):
    row = dict(seq=k, ts=datetime(2026, 1, 1) + timedelta(hours=k), source_bot="s", event_type="TRADE_OUTCOME", strategy_id="a", regime="BULL", score=None, expected_rr=None, pnl=None,
               outcome=None, symbol=None, setup_type=None, data_is_real=True, metadata=None) | values
    return tuple(row.values())


def events(spark, *rows):
    return spark.createDataFrame([event(k, **r) for k, r in enumerate(rows)], EVENT)


def signal(spark, *days, setup="BREAKOUT"):
    return spark.createDataFrame([(f"x{d}", "S", DAY + timedelta(days=d), "long", setup) for d in days], "signal_id string, symbol string, signal_date date, direction string, setup_type string")


UP = [(98, 100, 97, 99), (100, 106, 100, 105), (105, 111, 104, 110), (110, 115, 109, 114), (114, 118, 112, 116), (116, 119, 113, 117)]


def test_holding_period_exit(spark):
    t = backtest.backtest_trades(bar_frame(spark, UP), signal(spark, 0), backtest.BacktestRules(3)).first()
    assert (t.entry_price, t.exit_price, t.exit_reason, t.return_pct, t.drawdown_pct, t.days) == (100.0, 114.0, "holding_period", 14.0, 0.0, 3)


def test_end_of_data(spark):
    t = backtest.backtest_trades(bar_frame(spark, UP), signal(spark, 3), backtest.BacktestRules(5)).first()
    assert (t.exit_price, t.exit_reason, t.days, t.return_pct, t.drawdown_pct) == (117.0, "end_of_data", 2, 2.631579, -1.754386)


def test_stop_is_reached_before_target(spark):
    both = [(100, 100, 100, 100), (100, 120, 90, 110), (110, 110, 110, 110)]
    t = backtest.backtest_trades(bar_frame(spark, both), signal(spark, 0), backtest.BacktestRules(5, 0.05, 0.05)).first()
    assert (t.exit_reason, t.exit_price, t.return_pct, t.days) == ("stop_loss", 95.0, -5.0, 1)
    t = backtest.backtest_trades(bar_frame(spark, both), signal(spark, 0), backtest.BacktestRules(5, 0.05)).first()
    assert (t.exit_reason, t.exit_price) == ("take_profit", 105.0)


def test_summary_compounds_rounded_returns(spark):
    trades = spark.createDataFrame([("S", "A", 7.0, 2, 0.0), ("S", "A", -10.0, 2, -20.0)], "symbol string, setup string, return_pct double, days bigint, drawdown_pct double")
    s = backtest.backtest_summary(trades).first()
    assert (s.win_rate, s.avg_return_pct, s.cumulative_return_pct, s.max_drawdown_pct) == (0.5, -1.5, -3.7, -20.0)


def test_skips(spark):
    s = signal(spark, 5, 40).unionByName(signal(spark, 1).withColumn("direction", F.lit("short"))).unionByName(signal(spark, 1).withColumn("symbol", F.lit("T")))
    got = {r.reason: r.signals for r in backtest.backtest_skipped(bar_frame(spark, UP), s).collect()}
    assert got == {"no_entry_bar": 1, "date_not_found": 1, "unsupported_direction": 1, "symbol_mismatch": 1}


def test_trend(spark):
    r = last(bars.pattern(closes(spark, range(100, 107)), "trend_continuation", bars.PatternRules(trend=6)))
    assert (r.detected, r.confidence) == (True, 1.0)


def test_trend_takes_a_flat_last_bar_as_going_down(spark):
    assert last(bars.pattern(closes(spark, [107, 106, 105, 104, 103, 102, 102]), "trend_continuation", bars.PatternRules(trend=6))).detected


def test_mean_reversion(spark):
    r = last(bars.pattern(closes(spark, [100, 100, 100, 100, 110]), "mean_reversion_candidate", bars.PatternRules(lookback=5)))
    assert (r.detected, r.confidence) == (True, 0.5)
    assert last(bars.pattern(closes(spark, [100] * 5), "mean_reversion_candidate", bars.PatternRules(lookback=5))).reason == "zero_variance"


def test_gap(spark):
    rows = bar_frame(spark, [(100, 100, 100, 100), (103, 105, 102, 104)])
    r = last(bars.pattern(rows, "gap_continuation_risk"))
    assert (r.detected, r.confidence) == (True, 0.75)
    assert rows.withColumn("risk", bars.gap_risk()).orderBy(F.desc("date")).first().risk


def test_failed_breakout(spark):
    rows = bar_frame(spark, [(100, 102, 99, 100)] * 6 + [(101, 106, 100, 105), (105, 105, 100, 101)])
    assert last(bars.pattern(rows, "failed_breakout", bars.PatternRules(consolidation=6))).detected


def test_drawdown_recovery(spark):
    r = last(bars.pattern(closes(spark, [100, 120, 90, 95, 100, 105, 108]), "drawdown_recovery", bars.PatternRules(lookback=7)))
    assert (r.detected, r.confidence) == (True, 0.8)


def test_breakout_and_volume_spike(spark):
    rows = bar_frame(spark, [(100, 101, 99, 100, 1000)] * 7 + [(100, 104, 100, 103, 3000)])
    rules = bars.PatternRules(consolidation=6, volume_window=6)
    assert last(bars.pattern(rows, "breakout_after_consolidation", rules)).detected
    spike = last(bars.pattern(rows, "volume_spike", rules))
    assert (spike.detected, spike.confidence) == (True, 0.75)
    missing = rows.withColumn("volume", F.when(F.col("row_id") != 3, F.col("volume")))
    assert last(bars.pattern(missing, "volume_spike", rules)).reason == "volume_missing"


def test_patterns_never_look_ahead(spark):
    rows = bar_frame(spark, [(100 + k % 7, 103 + k % 7, 98 + k % 7, 101 + k % 5, 1000 + k) for k in range(40)])
    for name in bars.PATTERNS:
        whole = {r.date: tuple(r) for r in bars.pattern(rows, name).collect()}
        part = {r.date: tuple(r) for r in bars.pattern(rows.where("row_id < 30"), name).collect()}
        assert all(whole[d] == part[d] for d in part), name


def test_indicators(spark):
    flat = bars.macd(closes(spark, [5] * 40)).first()
    assert (flat.status, flat.macd, flat.histogram) == ("OK", 0.0, 0.0)
    assert [bars.macd(closes(spark, [1] * n), 2, 4, 2).first().status for n in (5, 6)] == ["FAIL_CLOSED", "OK"]
    b = last(bars.bollinger(closes(spark, [-2, -1, 1, 2]), 4))
    assert (b.mid, b.bandwidth) == (0.0, None) and b.percent_b is not None
    b = last(bars.bollinger(closes(spark, [3] * 4), 4))
    assert (b.status, b.mid, b.upper, b.percent_b, b.bandwidth) == ("FAIL_CLOSED", 3.0, 3.0, None, 0.0)


def test_bar_rules(spark):
    rows = bar_frame(spark, [(1, 2, 0.5, 1), (0, 2, 0.5, 1), (1, 0.5, 2, 1), (3, 2, 0.5, 1), (1, 2, 0.5, float("nan")), (1, 2, 0.5, 1, -1)])
    got = {r.error for r in bars.bar_validation(rows).collect()}
    assert {"open_invalid", "high_below_low", "open_outside_range", "close_invalid", "volume_negative"} <= got
    assert bars.valid_bars(rows).count() == 1 and bars.valid_bars(rows, strict=True).count() == 0


def test_setup_labels(spark):
    raw = [" breakout ", "BREAKOUT", None, "", "unknown", "odd", "rsi_cross_up\n"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string").orderBy("i")
    assert [tuple(r) for r in df.select(setup_label(F.col("x")), setup_recognised(F.col("x"))).collect()] == [
        ("BREAKOUT", True), ("BREAKOUT", True), ("UNKNOWN", True), ("UNKNOWN", True), ("UNKNOWN", True), ("UNKNOWN", False), ("RSI_CROSS_UP", True)]


def test_amounts(spark):
    r = outcomes.pnl_distribution(events(spark, dict(pnl=1.0), dict(pnl=-1.0), dict(pnl=2.0), dict(pnl=0.0), dict(pnl=None))).first()
    assert (r.n, r.mean, r.median, r.lowest, r.highest, r.total, r.wins, r.losses, r.breakevens) == (4, 0.5, 0.5, -1.0, 2.0, 2.0, 2, 1, 1)


def test_fit_is_withheld_below_thirty(spark):
    rows = [dict(outcome="WIN")] * 18 + [dict(outcome="LOSS")] * 12
    r = outcomes.regime_strategy_fit(events(spark, *rows)).first()
    assert (r.win_rate, r.status) == (0.6, "DIAGNOSTIC_ONLY")
    assert outcomes.regime_strategy_fit(events(spark, *rows[:29])).first().win_rate is None


def test_erosion_and_streaks(spark):
    df = events(spark, *[dict(outcome="WIN")] * 20, *[dict(outcome="LOSS")] * 10)
    e = sequences.edge_erosion(df).first()
    assert (e.warning, e.rolling_win_rate) == (True, 0.0)
    s = sequences.streak_analysis(df).first()
    assert (s.current_streak, s.max_win_streak, s.max_loss_streak, s.flagged) == (-10, 20, 10, True)
    s = sequences.streak_analysis(events(spark, dict(outcome="LOSS"), dict(outcome="BREAKEVEN"), dict(outcome="LOSS"))).first()
    assert s.max_loss_streak == 2


def test_bias(spark):
    rows = [dict(regime="BULL", outcome="WIN")] * 10 + [dict(regime="BEAR", event_type="RECOMMENDATION")] * 80 + [dict(regime="BEAR", outcome="WIN")] * 10
    got = {r.regime: r.flagged for r in sequences.regime_bias(events(spark, *rows)).collect()}
    assert got == {"BULL": True, "BEAR": False}


def test_calibration(spark):
    r = sequences.score_calibration_summary(events(spark, *[dict(score=i / 100, outcome="WIN" if i >= 50 else "LOSS") for i in range(100)])).first()
    assert (r.valid_bins, r.flagged) == (10, False)


def test_setup_summary_keeps_repeats_and_resets_on_other_outcomes(spark):
    rows = [(k, DAY, "BREAKOUT", o, 1.0, True, None) for k, o in enumerate(["WIN", "WIN", "PENDING", "WIN", "LOSS"])]
    df = spark.createDataFrame(rows, "seq bigint, date date, setup_label string, outcome string, return_pct double, data_is_real boolean, win boolean")
    r = outcomes.setup_outcome_summary(df, 5).first()
    assert (r["sample"], r.win_rate, r.longest_win, r.other, r.needed) == (5, 0.75, 2, 1, 0)
    assert outcomes.setup_outcome_summary(df).first().win_rate is None


def test_correlation(spark):
    rows = []
    for i in range(40):
        for stream, factor in (("x", 1.0), ("y", 2.0)):
            rows.append((stream, "TRADE_OUTCOME", "WIN", datetime(2026, 4, 1) + timedelta(days=i), factor * ((i % 7) - 3), True))
    df = spark.createDataFrame(rows, "stream string, event_type string, outcome string, ts timestamp, pnl double, data_is_real boolean")
    r = correlation.strategy_correlation(df, "x", "y").first()
    assert (r.overlap_days, r.correlation, r.status) == (40, 1.0, "small_sample")
    rolling = correlation.rolling_correlation(df, "x", "y").orderBy("day").collect()
    assert len(rolling) == 11 and rolling[-1].day == date(2026, 5, 10)
    few = correlation.strategy_correlation(df.where("ts < '2026-04-11'"), "x", "y").first()
    assert (few.status, few.correlation) == ("insufficient_overlap", None)
    flat = correlation.strategy_correlation(df.withColumn("pnl", F.lit(1.0)), "x", "y").first()
    assert flat.correlation is None


def test_floor(spark):
    at = datetime(2026, 1, 10)
    good = dict(sample_size=30, confidence=0.7, win_rate=0.55, edge=0.02, data_is_real=True, produced_at=at - timedelta(hours=168), fresh_until=None, regime="bull", regime_verified=True, exposure_increasing=True)
    cases = [({}, ""), (dict(sample_size=29), "sample_size_below_floor"), (dict(confidence=float("nan")), "confidence_invalid"), (dict(win_rate=None, edge=None), "edge_or_win_rate_missing"),
             (dict(data_is_real=None), "data_not_real"), (dict(produced_at=at + timedelta(hours=1)), "produced_at_future"), (dict(produced_at=at - timedelta(hours=169)), "evidence_stale"),
             (dict(fresh_until=at - timedelta(hours=1)), "evidence_stale"), (dict(regime="odd"), "regime_unknown_or_unsupported"), (dict(regime="odd", exposure_increasing=False), ""), (dict(produced_at=None), "produced_at_missing_or_invalid")]
    schema = "n int, sample_size int, confidence double, win_rate double, edge double, data_is_real boolean, produced_at timestamp, fresh_until timestamp, regime string, regime_verified boolean, exposure_increasing boolean"
    df = spark.createDataFrame([(n, *(good | c).values()) for n, (c, _) in enumerate(cases)], schema)
    got = floor.statistical_floor(df, F.lit(at)).orderBy("n").collect()
    assert [";".join(r.refusals) for r in got] == [e for _, e in cases]
    assert [r.approved for r in got] == [e == "" for _, e in cases]


def test_trend_report(spark):
    runs = spark.createDataFrame([(1, 100.0, 0.6), (2, 100.0, 0.6), (3, 150.0, 0.7)], "run int, total_events double, win_rate double")
    r = trend.cross_run_trend(runs).orderBy(F.desc("run")).first()
    assert (r.win_rate_delta, r.win_rate_shift, r.volume_delta, r.volume_shift) == (pytest.approx(0.1), True, 0.5, True)


def test_provenance():
    assert provenance.decide(True, True, False, 5)[:2] == ("stock_outcomes+generic", False)
    assert provenance.decide(False, True, True, 1)[:2] == ("stock_outcomes+options_advisory", True)
    assert provenance.decide(False, True, False, 0)[1] is False and provenance.decide(False, False, True, 0)[1] is False and provenance.decide(False, False, False, 0)[0] == "none"


def test_candidates_fall_back_to_half(spark):
    r = performance.candidate_ranking(events(spark, dict(symbol="A", event_type="REJECTION"))).first()
    assert r.composite == 0.25 and r.win_rate is None

"""Operators over the order of trades: rolling rates, streaks, erosion, calibration, bias and the observations on them.

Order is (ts, seq), which is total. Windows run per strategy over its trades; the overall last-N needs no window at all
(top N by order). Streaks are runs of pre-filtered trades, found in blocks of a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from outcomelens.functions.exprs import or_unknown, r6, ratio
from outcomelens.operators.events import is_trade
from outcomelens.operators.performance import data_quality, recommendation_quality, rejection_stats, strategy_stats
from outcomelens.operators.runs import as_series, islands, runs
from outcomelens.schema import BREAKEVEN, LOSS, THRESHOLDS, WIN, Thresholds


def _settled(events: DataFrame, *outcomes: str) -> DataFrame:
    return events.where(is_trade() & F.col("outcome").isin(*outcomes))


def rolling_win_rates(events: DataFrame, windows: tuple[int, ...] = (10, 30, 100)) -> DataFrame:
    """Win rate over the last 10, 30 and 100 settled trades, or as many as there are."""
    most = max(windows)
    last = _settled(events, WIN, LOSS, BREAKEVEN).select("ts", "seq", "outcome").orderBy(F.desc("ts"), F.desc("seq")).limit(most)
    numbered = last.withColumn("n", F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("seq"))))
    parts = numbered.select(F.explode(F.array(*[F.lit(w) for w in windows])).alias("window"), "n", "outcome").where("n <= window")
    rates = parts.groupBy("window").agg(F.count("*").alias("trades"), F.count_if(F.col("outcome") == WIN).alias("wins"))
    return rates.withColumn("win_rate", r6(ratio(F.col("wins"), F.col("trades"))))


def rolling_by_strategy(events: DataFrame, n: int = 10) -> DataFrame:
    """Win rate over each strategy's last n settled trades: a top-n per group, pruned before the shuffle (WindowGroupLimit)."""
    order = Window.partitionBy("strategy_id").orderBy(F.desc("ts"), F.desc("seq"))
    last = _settled(events, WIN, LOSS, BREAKEVEN).select("strategy_id", "ts", "seq", "outcome").withColumn("n", F.row_number().over(order)).where(F.col("n") <= n)
    rates = last.groupBy("strategy_id").agg(F.count("*").alias("trades"), F.count_if(F.col("outcome") == WIN).alias("wins"))
    return rates.withColumn("win_rate", r6(ratio(F.col("wins"), F.col("trades"))))


def streak_analysis(events: DataFrame, rules: Thresholds = THRESHOLDS) -> DataFrame:
    """Win and loss streaks per strategy; other outcomes are left out first, so they do not break a streak."""
    settled = _settled(events, WIN, LOSS)
    rows = as_series(settled, F.col("strategy_id"), F.col("ts"), F.date_trunc("day", "ts"), F.col("seq"), F.col("outcome"))
    found = runs(islands(rows))
    longest = lambda o: F.coalesce(F.max(F.when(F.col("value") == o, F.col("run"))), F.lit(0))
    signed = F.when(F.col("value") == WIN, F.col("run")).otherwise(-F.col("run"))
    stats = found.groupBy(F.col("series").alias("strategy_id")).agg(
        F.max_by(signed, F.struct("block", "island")).alias("current_streak"), longest(WIN).alias("max_win_streak"), longest(LOSS).alias("max_loss_streak")
    )
    loss = F.when(F.col("current_streak") < 0, -F.col("current_streak")).otherwise(0)
    return stats.withColumn("current_loss_streak", loss).withColumn("flagged", F.col("current_loss_streak") >= rules.loss_streak)


def edge_erosion(events: DataFrame, rules: Thresholds = THRESHOLDS) -> DataFrame:
    """Strategies with trades: how far the last ten trades lie below the whole record; at least three needed."""
    base = strategy_stats(events).where("trade_outcomes > 0").select("strategy_id", ratio(F.col("wins"), F.col("trade_outcomes")).alias("baseline"), "first_seq")
    rolling = rolling_by_strategy(events).where("trades >= 3").select("strategy_id", ratio(F.col("wins"), F.col("trades")).alias("rolling"))
    drop = F.col("baseline") - F.col("rolling")
    return base.join(rolling, "strategy_id").select(
        "strategy_id", r6(F.col("baseline")).alias("baseline_win_rate"), r6(F.col("rolling")).alias("rolling_win_rate"), r6(drop).alias("drop"), (drop >= rules.erosion).alias("warning")
    )


def regime_bias(events: DataFrame, rules: Thresholds = THRESHOLDS) -> DataFrame:
    """A regime's share of the trades against its share of all events; flagged beyond the multiplier."""
    counts = events.groupBy(or_unknown(F.col("regime")).alias("regime")).agg(F.count("*").alias("events"), F.count_if(is_trade()).alias("trades"))
    everything = Window.partitionBy()
    base = ratio(F.col("events"), F.sum("events").over(everything))
    rate = ratio(F.col("trades"), F.sum("trades").over(everything))
    shares = counts.withColumn("base", base).withColumn("rate", rate).where("rate is not null").withColumn("times", ratio(F.col("rate"), F.col("base")))
    return shares.select(
        "regime", "events", "trades", r6(F.col("base")).alias("base_rate"), r6(F.col("rate")).alias("trade_rate"), r6(F.col("times")).alias("multiplier"),
        (F.col("times") > rules.regime_multiplier).alias("flagged"),
    )


def _scored(events: DataFrame) -> DataFrame:
    return _settled(events, WIN, LOSS).where("score is not null").select("score", "outcome")


def score_calibration(events: DataFrame) -> DataFrame:
    """Ten equal-width score bins over settled trades, from the lowest to the highest score; scores are grouped before the
    bins are joined, and there are ten bins, whatever the input."""
    counted = _scored(events).groupBy("score").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == WIN).alias("w"))
    edges = counted.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).where("lo is not null")
    step = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / 10).otherwise(0.1)
    bins = edges.withColumn("step", step).withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(10))))
    upper = F.when(F.col("bin") < 10, F.col("lo") + F.col("bin") * F.col("step")).otherwise(F.col("hi") + 1e-9)
    bins = bins.select("bin", (F.col("lo") + (F.col("bin") - 1) * F.col("step")).alias("low"), upper.alias("high"))
    inside = F.broadcast(bins).join(counted, (F.col("score") >= F.col("low")) & (F.col("score") < F.col("high")), "left")
    found = inside.groupBy("bin", "low", "high").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("outcomes"), F.coalesce(F.sum("w"), F.lit(0)).alias("wins"))
    return found.select("bin", r6(F.col("low"), 3).alias("score_min"), r6(F.col("high"), 3).alias("score_max"), "outcomes", "wins", r6(ratio(F.col("wins"), F.col("outcomes"))).alias("win_rate"))


def score_calibration_summary(events: DataFrame, rules: Thresholds = THRESHOLDS) -> DataFrame:
    """Share of rises between consecutive bins with enough trades (three bins needed), and whether bin 1 beats bin 5."""
    bins = score_calibration(events)
    valid = bins.where((F.col("outcomes") >= rules.calibration_events) & F.col("win_rate").isNotNull())
    following = valid.withColumn("following", F.lead("win_rate").over(Window.orderBy("bin")))
    rises = following.agg(F.count("*").alias("valid_bins"), F.count_if(F.col("following") > F.col("win_rate")).alias("rises"))
    ends = bins.agg(F.max(F.when(F.col("bin") == 1, F.col("win_rate"))).alias("first"), F.max(F.when(F.col("bin") == 5, F.col("win_rate"))).alias("fifth"))
    share = F.when(F.col("valid_bins") >= 3, F.round(ratio(F.col("rises"), F.col("valid_bins") - 1), 3))
    joined = rises.withColumn("k", F.lit(1)).join(ends.withColumn("k", F.lit(1)), "k")
    return joined.select("valid_bins", share.alias("coefficient"), F.coalesce(F.col("first") > F.col("fifth"), F.lit(False)).alias("flagged"))


def observations(events: DataFrame, rules: Thresholds = THRESHOLDS) -> DataFrame:
    """What a reader should know, as (ordinal, rule, subject, value); the wording is the report's."""
    row = lambda df, n, rule, subject, value: df.select(F.lit(n).alias("ordinal"), F.lit(rule).alias("rule"), subject.alias("subject"), r6(value.cast("double")).alias("value"))
    none = F.lit("")
    quality = data_quality(events).withColumn("share", ratio(F.col("missing_outcome"), F.col("total_events")))
    stats = strategy_stats(events).where("trade_outcomes >= 5")
    recs = recommendation_quality(events)
    parts = [
        row(quality.where("share > 0.3"), 1, "missing_outcome", none, F.col("share")),
        row(stats.where("win_rate < 0.35"), 2, "weak_strategy", F.col("strategy_id"), F.col("win_rate")),
        row(stats.where("win_rate > 0.70"), 2, "strong_strategy", F.col("strategy_id"), F.col("win_rate")),
        row(recs.where("high_score_win_rate < low_score_win_rate"), 3, "score_inversion", none, F.col("high_score_win_rate")),
        row(score_calibration_summary(events, rules).where("flagged"), 4, "calibration", none, F.col("coefficient")),
        row(regime_bias(events, rules).where("flagged"), 5, "regime_bias", F.col("regime"), F.col("multiplier")),
        row(edge_erosion(events, rules).where("warning"), 6, "edge_erosion", F.col("strategy_id"), F.col("drop")),
        row(streak_analysis(events, rules).where("flagged"), 7, "loss_streak", F.col("strategy_id"), F.col("current_loss_streak")),
        row(rejection_stats(events).where("rejection_rate > 0.5"), 8, "rejection_rate", none, F.col("rejection_rate")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def strategy_dashboard(events: DataFrame, rules: Thresholds = THRESHOLDS) -> DataFrame:
    """Strategies with the flags of their streak and erosion."""
    streaks = streak_analysis(events, rules).where("flagged").select("strategy_id", F.lit(True).alias("s"))
    eroded = edge_erosion(events, rules).where("warning").select("strategy_id", F.lit(True).alias("e"))
    stats = strategy_stats(events).select("strategy_id", "trade_outcomes", "wins", "losses", "win_rate", "total_pnl")
    joined = stats.join(streaks, "strategy_id", "left").join(eroded, "strategy_id", "left")
    no = F.lit(False)
    return joined.select("strategy_id", "trade_outcomes", "wins", "losses", "win_rate", "total_pnl", F.coalesce("s", no).alias("loss_streak"), F.coalesce("e", no).alias("edge_erosion"))

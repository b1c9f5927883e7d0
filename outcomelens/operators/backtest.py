"""Deterministic long-only backtest: entry at the open after a signal, exit at stop, target or the end of the holding period.

Bars are numbered per symbol; a trade meets the bars of its holding period by an equi-join on symbol and bar number (the
period is expanded to its numbers, so the fan-out is the holding period and no range join is needed). The stop is taken
to be reached before the target within one bar. Returns are rounded before they are averaged and compounded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from outcomelens.functions.exprs import r6, ratio, setup_label
from outcomelens.operators.bars import by_date


@dataclass(frozen=True)
class BacktestRules:
    holding: int = 5
    take_profit: float | None = None
    stop_loss: float | None = None


def numbered(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "date", "open", "high", "low", "close", F.row_number().over(by_date()).alias("n"), F.count("*").over(Window.partitionBy("symbol")).alias("bars"))


def placed(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals (signal_id, symbol, signal_date, direction, setup_type) with the number of their bar and a reason to skip."""
    known = numbered(bars)
    dates = known.select("symbol", F.col("date").alias("signal_date"), "n", "bars")
    symbols = known.select("symbol").distinct().withColumn("series", F.lit(True))
    joined = signals.join(symbols, "symbol", "left").join(dates, ["symbol", "signal_date"], "left")
    reason = (
        F.when(F.col("series").isNull(), "symbol_mismatch")
        .when(F.coalesce("direction", F.lit("")) != "long", "unsupported_direction")
        .when(F.col("n").isNull(), "date_not_found")
        .when(F.col("n") >= F.col("bars"), "no_entry_bar")
    )
    return joined.withColumn("skip_reason", reason)


def backtest_skipped(bars: DataFrame, signals: DataFrame) -> DataFrame:
    return placed(bars, signals).groupBy(F.coalesce("skip_reason", F.lit("traded")).alias("reason")).agg(F.count("*").alias("signals"))


def backtest_trades(bars: DataFrame, signals: DataFrame, rules: BacktestRules = BacktestRules()) -> DataFrame:
    """One row per signal that could be traded."""
    last = F.least(F.col("n") + rules.holding, F.col("bars"))
    trades = placed(bars, signals).where("skip_reason is null").select(
        "signal_id", "symbol", "signal_date", setup_label(F.col("setup_type")).alias("setup"), (F.col("n") + 1).alias("entry"), last.alias("last"), (F.col("n") + rules.holding).alias("full_last")
    )
    at = numbered(bars).select("symbol", F.col("n").alias("at"), "date", "open", "high", "low", "close")
    held = trades.withColumn("at", F.explode(F.sequence("entry", "last"))).join(at, ["symbol", "at"])
    trade = Window.partitionBy("signal_id")
    price = F.first(F.when(F.col("at") == F.col("entry"), F.col("open")), ignorenulls=True).over(trade)
    held = held.withColumn("price", price)
    never = F.lit(None).cast("double")
    stop = never if rules.stop_loss is None else F.col("price") * (1 - rules.stop_loss)
    target = never if rules.take_profit is None else F.col("price") * (1 + rules.take_profit)
    hit = F.when(F.col("low") <= stop, "stop_loss").when(F.col("high") >= target, "take_profit")
    held = held.withColumn("stop", stop).withColumn("target", target).withColumn("hit", hit)
    held = held.withColumn("exit", F.coalesce(F.min(F.when(F.col("hit").isNotNull(), F.col("at"))).over(trade), F.col("last"))).where("at <= exit")
    leaving = F.col("at") == F.col("exit")
    on_exit = lambda c: F.max(F.when(leaving, c))
    natural = F.when(F.col("exit") == F.col("full_last"), "holding_period").otherwise("end_of_data")
    exit_price = F.when(F.col("hit") == "stop_loss", F.col("stop")).when(F.col("hit") == "take_profit", F.col("target")).otherwise(F.col("close"))
    done = held.groupBy("signal_id", "symbol", "signal_date", "setup").agg(
        F.max(F.when(F.col("at") == F.col("entry"), F.col("date"))).alias("entry_date"), F.max("price").alias("price"), on_exit(F.col("date")).alias("exit_date"),
        on_exit(exit_price).alias("exit_price"), on_exit(F.coalesce("hit", natural)).alias("exit_reason"), F.count("*").alias("days"), F.min("low").alias("lowest"),
    )
    gain = lambda c: r6((F.col(c) - F.col("price")) / F.col("price") * 100)
    return done.select(
        "signal_id", "symbol", "signal_date", "setup", "entry_date", r6(F.col("price")).alias("entry_price"), "exit_date", r6(F.col("exit_price")).alias("exit_price"),
        "exit_reason", "days", gain("exit_price").alias("return_pct"), gain("lowest").alias("drawdown_pct"),
    )


def _summary() -> list[Column]:
    """Compounding by summed logarithms: a mergeable aggregate; a loss of all or more makes it -100 %."""
    growth = 1 + F.col("return_pct") / 100
    product = F.when(F.min(growth) <= 0, 0.0).otherwise(F.exp(F.sum(F.when(growth > 0, F.log(growth)))))
    wins = F.count_if(F.col("return_pct") > 0)
    return [
        F.count("*").alias("trades"), wins.alias("wins"), (F.count("*") - wins).alias("losses"), r6(ratio(wins, F.count("*"))).alias("win_rate"), F.round(F.avg("return_pct"), 4).alias("avg_return_pct"),
        F.round((product - 1) * 100, 3).alias("cumulative_return_pct"), r6(F.avg("days")).alias("avg_days"), F.min("drawdown_pct").alias("max_drawdown_pct"),
    ]


def backtest_summary(trades: DataFrame) -> DataFrame:
    return trades.groupBy("symbol").agg(*_summary())


def backtest_by_setup(trades: DataFrame) -> DataFrame:
    return trades.groupBy("symbol", "setup").agg(*_summary())


def setup_expectancy(trades: DataFrame, floor: int = 30, edge: float = 0.02, win_rate: float = 0.55) -> DataFrame:
    """Setups ranked by their average return, with the verdict of the statistical floor on sample, win rate and edge."""
    sums = trades.groupBy("setup").agg(*_summary())
    order = Window.orderBy(F.col("avg_return_pct").desc_nulls_last(), "setup")
    passed = (F.col("trades") >= floor) & (F.col("win_rate") >= win_rate) & (F.col("avg_return_pct") / 100 >= edge)
    return sums.select(F.row_number().over(order).alias("rank"), "setup", "trades", "win_rate", "avg_return_pct", F.when(passed, "STRONG").otherwise("DIAGNOSTIC_ONLY").alias("strength"))

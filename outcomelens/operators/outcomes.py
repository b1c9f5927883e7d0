"""Distributions, holding periods, regime fit and per-setup outcome summaries. Rates are withheld (null) below a stated
sample, never estimated; null, NaN and infinite amounts are no values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from outcomelens.functions.exprs import label, money, r6, ratio, setup_label, setup_recognised, withhold
from outcomelens.operators.events import is_trade
from outcomelens.operators.runs import as_series, longest
from outcomelens.schema import BREAKEVEN, LOSS, OUTCOMES, REGIMES, WIN


def _amounts(events: DataFrame) -> DataFrame:
    return events.where(is_trade() & F.col("pnl").isNotNull())


def _signs() -> list[Column]:
    pnl = F.col("pnl")
    return [F.count("*").alias("n"), F.count_if(pnl > 0).alias("wins"), F.count_if(pnl < 0).alias("losses"), F.count_if(pnl == 0).alias("breakevens")]


def pnl_distribution(events: DataFrame) -> DataFrame:
    """Exact mean and median, population deviation (null for one value)."""
    pnl = F.col("pnl")
    total = money(pnl)
    return _amounts(events).agg(
        *_signs(), total.alias("total"), r6(ratio(total, F.count("*"))).alias("mean"), r6(F.median(pnl)).alias("median"), F.min(pnl).alias("lowest"),
        F.max(pnl).alias("highest"), F.when(F.count("*") >= 2, F.round(F.stddev_pop(pnl), 2)).alias("deviation"),
    )


def pnl_by_strategy(events: DataFrame) -> DataFrame:
    total = money(F.col("pnl"))
    return _amounts(events).groupBy("strategy_id").agg(*_signs(), total.alias("total"), r6(ratio(total, F.count("*"))).alias("mean"))


def pnl_histogram(events: DataFrame, bins: int = 6) -> DataFrame:
    """Equal-width bins, the last one closed; a single bin where all values are equal. Bins without values are listed."""
    values = _amounts(events).select("pnl")
    edges = values.agg(F.min("pnl").alias("lo"), F.max("pnl").alias("hi")).where("lo is not null")
    width = (F.col("hi") - F.col("lo")) / bins
    ends = F.when(F.col("hi") > F.col("lo"), bins).otherwise(1)
    parts = edges.withColumn("width", width).withColumn("last", ends).withColumn("bin", F.explode(F.sequence(F.lit(1), F.col("last"))))
    parts = parts.select(
        "bin", "last", (F.col("lo") + (F.col("bin") - 1) * F.col("width")).alias("low"), F.when(F.col("bin") == F.col("last"), F.col("hi")).otherwise(F.col("lo") + F.col("bin") * F.col("width")).alias("high")
    )
    counted = values.groupBy("pnl").agg(F.count("*").alias("k"))
    inside = (F.col("pnl") >= F.col("low")) & ((F.col("pnl") < F.col("high")) | ((F.col("bin") == F.col("last")) & (F.col("pnl") <= F.col("high"))))
    joined = F.broadcast(parts).join(counted, inside, "left")
    return joined.groupBy("bin", "low", "high").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n")).select("bin", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"), "n")


# ---- holding periods


def holding_status(entry: Column, leaving: Column) -> Column:
    """missing (either end), invalid (not after the start, or only one of the two texts has a zone), ok."""
    zoned = lambda c: c.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})\s*$")
    start, end = instant(entry), instant(leaving)
    return F.when(start.isNull() | end.isNull(), "missing").when((zoned(entry) != zoned(leaving)) | (end <= start), "invalid").otherwise("ok")


def instant(text: Column) -> Column:
    return F.btrim(text).try_cast("timestamp")


def holding_rows(rows: DataFrame) -> DataFrame:
    """(strategy_id, entry_time, exit_time as texts) with status and days."""
    days = (F.unix_micros(instant(F.col("exit_time"))) - F.unix_micros(instant(F.col("entry_time")))) / F.lit(86_400_000_000.0)
    status = holding_status(F.col("entry_time"), F.col("exit_time"))
    return rows.withColumn("status", status).withColumn("days", F.when(F.col("status") == "ok", days))


def _span() -> list[Column]:
    days = F.col("days")
    return [F.count(days).alias("n"), r6(F.avg(days)).alias("mean_days"), r6(F.median(days)).alias("median_days"), r6(F.min(days)).alias("shortest"), r6(F.max(days)).alias("longest")]


def holding_period_summary(rows: DataFrame) -> DataFrame:
    skipped = [F.count_if(F.col("status") == s).alias(f"skipped_{s}") for s in ("missing", "invalid")]
    return holding_rows(rows).agg(*_span(), *skipped)


def holding_period_by_strategy(rows: DataFrame) -> DataFrame:
    return holding_rows(rows).where("status = 'ok'").groupBy("strategy_id").agg(*_span())


# ---- regime and strategy


def fit_regime(regime: Column) -> Column:
    return F.when(label(regime).isin(*REGIMES), label(regime)).otherwise("UNKNOWN")


def regime_strategy_fit(events: DataFrame, floor: int = 30) -> DataFrame:
    """Trades per regime and strategy; the win rate over decisive trades, from `floor` decisive trades on."""
    trades = events.where(is_trade()).groupBy(fit_regime(F.col("regime")).alias("regime"), "strategy_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("outcome") == WIN).alias("wins"), F.count_if(F.col("outcome") == LOSS).alias("losses")
    )
    decisive = trades.withColumn("decisive", F.col("wins") + F.col("losses"))
    enough = F.col("decisive") >= floor
    status = F.when(enough, "DIAGNOSTIC_ONLY").otherwise("INSUFFICIENT_SAMPLE")
    return decisive.withColumn("win_rate", withhold(F.round(ratio(F.col("wins"), F.col("decisive")), 4), enough)).withColumn("status", status)


def regime_strategy_grid(events: DataFrame, floor: int = 30) -> DataFrame:
    """The fit as a grid of all its regimes and strategies, missing cells included (both lists are short dimensions)."""
    fit = regime_strategy_fit(events, floor)
    grid = fit.select("strategy_id").distinct().withColumn("regime", F.explode(F.array(*[F.lit(r) for r in REGIMES])))
    cell = F.when(F.col("total").isNull(), "-").when(F.col("win_rate").isNull(), "withheld").otherwise("shown")
    return grid.join(fit, ["regime", "strategy_id"], "left").select("regime", "strategy_id", cell.alias("cell"), F.coalesce("decisive", F.lit(0)).alias("decisive"), "win_rate")


# ---- outcomes per setup


def outcome_label(raw: Column) -> Column:
    return F.when(label(raw).isin(*OUTCOMES), label(raw)).otherwise("UNKNOWN")


def outcomes_from_events(events: DataFrame) -> DataFrame:
    """Trade outcomes as (seq, date, setup_label, outcome, return_pct, data_is_real)."""
    setup = F.coalesce(F.nullif(F.col("strategy_id"), F.lit("")), F.col("setup_type"), F.lit(""))
    day = F.coalesce(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    pct = F.from_json("metadata", "pnl_pct double")["pnl_pct"]
    return events.where(is_trade()).select("seq", day.alias("date"), setup.alias("setup_label"), F.coalesce("outcome", F.lit("")).alias("outcome"), pct.alias("return_pct"), "data_is_real")


def _longest(rows: DataFrame, state: str, states: dict[str, str]) -> DataFrame:
    """Longest runs per setup in order of (date, seq); a row in any other state ends them."""
    series = as_series(rows, F.col("setup"), F.col("date"), F.date_trunc("month", "date"), F.col("seq"), F.col(state))
    return longest(series, states).withColumnRenamed("series", "setup").drop("field")


def setup_outcome_summary(records: DataFrame, floor: int = 30) -> DataFrame:
    """Per setup: the win rate needs `floor` records, the status as many real ones; identical records each count."""
    rows = records.withColumn("setup", setup_label(F.col("setup_label"))).withColumn("result", outcome_label(F.col("outcome")))
    is_ = lambda o: F.count_if(F.col("result") == o)
    sums = rows.groupBy("setup").agg(
        F.count("*").alias("sample"), F.count_if("data_is_real").alias("real"), is_(WIN).alias("wins"), is_(LOSS).alias("losses"), is_(BREAKEVEN).alias("breakevens"),
        F.round(F.avg("return_pct"), 4).alias("mean_return"), F.bool_and("data_is_real").alias("all_real"),
    )
    runs = _longest(rows, "result", {WIN: "longest_win", LOSS: "longest_loss"})
    decisive, enough = F.col("wins") + F.col("losses"), F.col("sample") >= floor
    return sums.join(runs, "setup").select(
        "setup", "sample", "real", F.greatest(F.lit(0), floor - F.col("real")).alias("needed"), "wins", "losses", "breakevens",
        (F.col("sample") - decisive - F.col("breakevens")).alias("other"), withhold(F.round(ratio(F.col("wins"), decisive), 4), enough).alias("win_rate"),
        withhold(F.col("mean_return"), enough).alias("mean_return"), "longest_win", "longest_loss", "all_real",
        F.when(F.col("real") >= floor, "DIAGNOSTIC_ONLY").otherwise("INSUFFICIENT_SAMPLE").alias("status"),
    )


def win_loss_clusters(records: DataFrame, least: int = 6, length: int = 3) -> DataFrame:
    """Per setup and overall ('*'): wins, losses and longest runs of (seq, date, setup_label, win); no rows below `least`."""
    rows = records.where("win is not null").select("seq", "date", F.explode(F.array(setup_label(F.col("setup_label")), F.lit("*"))).alias("setup"), F.col("win").cast("string").alias("state"))
    sums = rows.groupBy("setup").agg(F.count("*").alias("n"), F.count_if(F.col("state") == "true").alias("wins"))
    runs = _longest(rows, "state", {"true": "longest_win", "false": "longest_loss"})
    total = sums.where("setup = '*'").select(F.col("n").alias("everything"), F.lit(1).alias("k"))
    joined = sums.join(runs, "setup").withColumn("k", F.lit(1)).join(F.broadcast(total), "k").where(F.col("everything") >= least)
    flagged = F.greatest("longest_win", "longest_loss") >= length
    return joined.select("setup", "n", "wins", (F.col("n") - F.col("wins")).alias("losses"), F.round(ratio(F.col("wins"), F.col("n")), 4).alias("win_rate"), "longest_win", "longest_loss", flagged.alias("flagged"))


def unrecognised_labels(records: DataFrame) -> DataFrame:
    """Labels that name no known setup, with their first appearance."""
    odd = records.where(~setup_recognised(F.col("setup_label")))
    return odd.groupBy("setup_label").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"))

"""Comparison of a run with the runs before it, as windows over a table of run snapshots (run, total_events, win_rate)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from outcomelens.functions.exprs import finite, r6, ratio
from outcomelens.schema import THRESHOLDS, Thresholds


def cross_run_trend(runs: DataFrame, rules: Thresholds = THRESHOLDS) -> DataFrame:
    """Every run against the mean of up to trend_lookback runs before it; the first run has nothing to compare."""
    before = Window.orderBy("run").rowsBetween(-rules.trend_lookback, -1)
    rate = finite(F.col("win_rate"))
    rows = runs.select(
        "run", "total_events", rate.alias("win_rate"), F.count("*").over(before).alias("compared"), F.avg(rate).over(before).alias("usual_rate"),
        F.avg(F.coalesce("total_events", F.lit(0))).over(before).alias("usual_events"),
    ).where("compared > 0")
    shift = F.col("win_rate") - F.col("usual_rate")
    volume = ratio(F.col("total_events") - F.col("usual_events"), F.col("usual_events"))
    off = lambda c, by: F.coalesce(F.abs(c) >= by, F.lit(False))
    return rows.select(
        "run", "compared", r6(F.col("win_rate")).alias("win_rate"), r6(shift).alias("win_rate_delta"), off(shift, rules.win_rate_shift).alias("win_rate_shift"),
        r6(volume).alias("volume_delta"), off(volume, rules.volume_shift).alias("volume_shift"),
    )


def trend_strategy_mix(tops: DataFrame, n: int = 5) -> DataFrame:
    """Strategies that entered or left the n busiest of a run against the run before; tops: (run, strategy_id, trades)."""
    best = Window.partitionBy("run").orderBy(F.desc("trades"), "strategy_id")
    top = tops.withColumn("k", F.row_number().over(best)).where(F.col("k") <= n).select("run", "strategy_id")
    runs = top.select("run").distinct()
    order = Window.orderBy("run")
    pairs = runs.select("run", F.lag("run").over(order).alias("before")).where("before is not null")
    now = pairs.join(top, "run").select("run", "before", "strategy_id")
    then = pairs.join(top.withColumnRenamed("run", "before"), "before").select("run", "before", "strategy_id")
    added = now.join(then, ["run", "before", "strategy_id"], "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(then.join(now, ["run", "before", "strategy_id"], "left_anti").withColumn("change", F.lit("removed"))).select("run", "strategy_id", "change")

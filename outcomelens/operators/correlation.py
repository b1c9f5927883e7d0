"""Correlation of daily amounts of two streams, with eligibility, floors and a rolling variant.

Amounts are summed per stream and UTC day before anything is joined, so a stream is as many rows as it has days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from outcomelens.functions.exprs import money, r6, withhold
from outcomelens.operators.events import is_trade
from outcomelens.schema import PENDING, THRESHOLDS, Thresholds

WINDOW = 30


def exclusion_reason(real_only: bool = True) -> Column:
    """First rule an event breaks; null for an eligible one. real_only: amounts that are not real count for nothing."""
    rules = (
        F.when(~is_trade(), "not_trade_outcome")
        .when(F.coalesce("outcome", F.lit("")) == PENDING, "outcome_pending")
        .when(F.col("ts").isNull(), "timestamp_invalid")
        .when(F.col("pnl").isNull(), "realized_pnl_missing_or_invalid")
    )
    return rules.when(~F.col("data_is_real"), "data_not_real") if real_only else rules


def correlation_exclusions(streams: DataFrame) -> DataFrame:
    """Events per stream and reason, 'eligible' for the rest."""
    return streams.groupBy("stream", F.coalesce(exclusion_reason(), F.lit("eligible")).alias("reason")).agg(F.count("*").alias("events"))


def daily_pnl(streams: DataFrame, real_only: bool = True) -> DataFrame:
    return streams.where(exclusion_reason(real_only).isNull()).groupBy("stream", F.to_date("ts").alias("day")).agg(money(F.col("pnl")).alias("pnl"))


def overlap(streams: DataFrame, a: str, b: str, real_only: bool = True) -> DataFrame:
    """Days on which both streams have amounts."""
    days = daily_pnl(streams, real_only)
    left = days.where(F.col("stream") == a).select("day", F.col("pnl").alias("a"))
    return left.join(days.where(F.col("stream") == b).select("day", F.col("pnl").alias("b")), "day")


def pearson(cov: Column, dev_a: Column, dev_b: Column) -> Column:
    """Clamped to [-1, 1]. Rounding may leave a constant series a tiny deviation: callers test for one by its extremes."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(cov, F.nullif(dev_a * dev_b, F.lit(0.0)))))


def strategy_correlation(streams: DataFrame, a: str, b: str, rules: Thresholds = THRESHOLDS, real_only: bool = True) -> DataFrame:
    """One row: correlation and Fisher interval, withheld below the sample of overlapping days."""
    varied = (F.min("a") < F.max("a")) & (F.min("b") < F.max("b"))
    stats = overlap(streams, a, b, real_only).agg(
        F.count("*").alias("n"), F.covar_pop("a", "b").alias("cov"), F.stddev_pop("a").alias("da"), F.stddev_pop("b").alias("db"), varied.alias("varied")
    )
    r = F.when((F.col("n") >= 2) & F.col("varied"), pearson(F.col("cov"), F.col("da"), F.col("db")))
    enough = F.col("n") >= rules.sample
    bounded = (F.col("n") >= 4) & (F.abs("r") < 1)
    half = 1.96 / F.sqrt(F.col("n") - 3)
    ends = [withhold(r6(F.when(bounded, F.tanh(F.atanh("r") + sign * F.when(F.col("n") > 3, half)))), enough).alias(name) for sign, name in ((-1, "low"), (1, "high"))]
    status = F.when(~enough, "insufficient_overlap").when(F.col("n") < rules.small_overlap, "small_sample").otherwise("ok")
    return stats.withColumn("r", r).select(F.col("n").alias("overlap_days"), withhold(r6(F.col("r")), enough).alias("correlation"), *ends, status.alias("status"))


def rolling_correlation(streams: DataFrame, a: str, b: str, window: int = WINDOW, real_only: bool = True) -> DataFrame:
    """Correlation over the trailing `window` days of the overlap (rows, not calendar days), from the first full window on."""
    order = Window.orderBy("day").rowsBetween(-(window - 1), 0)
    days = overlap(streams, a, b, real_only)
    varied = (F.min("a").over(order) < F.max("a").over(order)) & (F.min("b").over(order) < F.max("b").over(order))
    rows = days.select(
        "day", F.row_number().over(Window.orderBy("day")).alias("k"),
        r6(F.when(varied, pearson(F.covar_pop("a", "b").over(order), F.stddev_pop("a").over(order), F.stddev_pop("b").over(order))), 4).alias("correlation"),
    )
    return rows.where(F.col("k") >= window).select("day", "correlation")

"""Seeded synthetic bars and signals for soak studies: a random walk with drift, a signal every third bar."""

from __future__ import annotations

import random
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

#: Profiles of the expectancy study, setup -> (drift, noise).
PROFILES = {"BREAKOUT": (0.012, 0.01), "TREND_PULLBACK": (0.006, 0.012), "TREND_CONTINUATION": (0.003, 0.012), "RSI_CROSS_UP": (0.0, 0.015), "OVERSOLD_REBOUND": (-0.004, 0.015)}


def walk(symbol: str, setup: str, signals: int, drift: float, noise: float, seed: int) -> tuple[list[tuple], list[tuple]]:
    source, price, day = random.Random(seed), 100.0, date(2024, 1, 1)
    bars, named = [], []
    for n in range(3 * signals + 8):
        opened = price
        price = max(0.01, opened * (1 + drift + source.uniform(-noise, noise)))
        high, low = max(opened, price) * (1 + noise / 2), min(opened, price) * (1 - noise / 2)
        bars.append((n, symbol, day + timedelta(days=n), opened, high, low, price, 1000))
        if n % 3 == 0 and len(named) < signals:
            named.append((f"{symbol}#{n}", symbol, day + timedelta(days=n), "long", setup))
    return bars, named


def inputs(spark: SparkSession, signals: int = 40, seed: int = 7, profiles: dict[str, tuple[float, float]] = PROFILES) -> tuple[DataFrame, DataFrame]:
    """(bars, signals) with one symbol per setup profile."""
    bars, named = [], []
    for k, (setup, (drift, noise)) in enumerate(profiles.items()):
        b, s = walk(f"SYN_{setup}", setup, signals, drift, noise, seed + k)
        bars, named = bars + b, named + s
    return (
        spark.createDataFrame(bars, "row_id int, symbol string, date date, open double, high double, low double, close double, volume bigint"),
        spark.createDataFrame(named, "signal_id string, symbol string, signal_date date, direction string, setup_type string"),
    )

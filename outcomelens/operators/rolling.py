"""Rolling totals over trailing calendar periods, quiet days included, from contribution deltas.

An amount of day d enters every trailing window of n days at d and leaves it at d + n. The signed deltas are summed per
entity and day, their running sum is the total, and it stays constant until the entity's next delta: the days in
between are filled from that segment, so no calendar is joined and no frame is re-aggregated. Amounts are summed per
entity and day before the shuffle, so an entity is at most as many rows as it has days.

Nulls: rows without entity or day are left out; a null, NaN or infinite amount counts as nothing but its day still is a
day of the entity. Amounts are whole cents, as decimals (exact and order-free).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PERIODS = (7, 30)
CENTS = "decimal(38,0)"


def whole_cents(amount: Column) -> Column:
    """Exact cents of a double; null where it is not finite."""
    finite = F.when(~F.isnan(amount) & (F.abs(amount) < F.lit(1e34)), amount)
    return F.round(finite * 100).cast(CENTS)


def daily(rows: DataFrame, entity: str, at: str, amount: str) -> DataFrame:
    """(entity, day, cents): one row per entity and day with any row."""
    return (
        rows.select(F.col(entity).alias("entity"), F.to_date(at).alias("day"), whole_cents(F.col(amount)).alias("cents"))
        .where("entity is not null and day is not null")
        .groupBy("entity", "day")
        .agg(F.coalesce(F.sum("cents"), F.lit(0).cast(CENTS)).alias("cents"))
    )


def segments(days: DataFrame, periods: tuple[int, ...] = PERIODS) -> DataFrame:
    """(entity, first_day, last_day, total_<n>...): stretches of days with constant totals, between first and last event."""
    zero = F.lit(0).cast(CENTS)
    steps = [F.struct(F.col("day").alias("at"), F.lit(True).alias("active"), *[F.col("cents").alias(f"d{n}") for n in periods])]
    for leaving in periods:
        moved = [(-F.col("cents")).cast(CENTS).alias(f"d{n}") if n == leaving else zero.alias(f"d{n}") for n in periods]
        steps.append(F.struct(F.date_add("day", leaving).alias("at"), F.lit(False).alias("active"), *moved))
    deltas = (
        days.select("entity", F.explode(F.array(*steps)).alias("s"))
        .select("entity", "s.*")
        .groupBy("entity", "at")
        .agg(F.max("active").alias("active"), *[F.sum(f"d{n}").alias(f"d{n}") for n in periods])
    )
    order = Window.partitionBy("entity").orderBy("at")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("active"), F.col("at"))).over(whole)
    return (
        deltas.select(
            "entity",
            F.col("at").alias("first_day"),
            F.least(F.date_sub(F.lead("at").over(order), 1), last).alias("last_day"),
            *[F.sum(f"d{n}").over(running).alias(f"total_{n}") for n in periods],
        )
        .where("first_day <= last_day")
    )


def by_day(parts: DataFrame) -> DataFrame:
    """One row per entity and calendar day of the given segments."""
    totals = [c for c in parts.columns if c.startswith("total_")]
    return parts.select("entity", F.explode(F.sequence("first_day", "last_day")).alias("day"), *totals)


def rolling_totals(rows: DataFrame, entity: str, at: str, amount: str, periods: tuple[int, ...] = PERIODS) -> DataFrame:
    """(entity, day, total_<n>, average_<n>): totals in currency and per-day averages over the trailing n days."""
    found = by_day(segments(daily(rows, entity, at, amount), periods))
    money = [(F.col(f"total_{n}").cast("double") / 100).alias(f"total_{n}") for n in periods]
    means = [F.round(F.col(f"total_{n}").cast("double") / (100 * n), 6).alias(f"average_{n}") for n in periods]
    return found.select("entity", "day", *money, *means)

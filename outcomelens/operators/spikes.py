"""Readings that cannot be right for their series: impossible values, spikes and stuck values.

Spikes are found by peaks over threshold. A reading is detrended (distance from a centred running median of the readings
around it, or from the median of its series in the month) and deseasoned (the median of the detrended readings of its
series on that day of the week). The residuals of a series beyond the quantile THRESHOLD of its field are exceedances,
measured in units of that threshold. A generalised Pareto tail is fitted to them by likelihood: the shape from all series
of a field together, the scale of each series from its own exceedances and, as a short series has few, PRIOR exceedances
spread as those of the field. For the shape the exceedances of every series are first brought to the same median. The likelihood is truncated at the fence, beyond which the fitted tail has one exceedance in
a thousand, so that the spikes themselves do not stretch the tail. The cutoff of a series is its tail's quantile at a fixed
risk. Shapes lie between 0 (a light tail counts as exponential) and 0.3; cutoffs between LOWEST and HIGHEST thresholds,
which are there for series unlike any other. A lasting new level moves the running median along and is no spike.

Stuck values are runs of equal consecutive readings that are much longer than the run lengths the series shows
otherwise (RUN_QUANTILE of its run lengths, times stretch, at least shortest); all but the first row of a run are flagged. As stuck
runs are among these lengths, the quantile counts for at most RUN_REACH medians: lengths that fall off evenly have it at
some four medians, so that only few or many stuck runs push it beyond.

Long series are cut into blocks of time. Runs are found inside the blocks and joined across them by a second pass over
the first and last run of each block, exactly; running medians use the neighbours inside the block. Levels, thresholds
and the histograms of exceedances are mergeable aggregates, so one series may hold any share of the rows.

Nulls are skipped; a null series or instant leaves only the rules for impossible values (and, without instant, the
level of the whole series). Where most residuals of a series are zero, the threshold is taken from the others; a constant
series has no spikes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from outcomelens.operators.runs import islands, runs
from outcomelens.session import cut

RUN_QUANTILE = 0.95
RUN_REACH = 5
ACCURACY = 1000
LEAST_SEASON = 30  # readings from which a month or a day of the week has a level of its own
PRIOR = 100.0
FENCE = 1e-3
LOWEST, HIGHEST = 2.0, 20.0
WIDTH, BINS = 0.02, 500  # of the histograms of exceedances
MEDIAN = 0.25  # to which the exceedances of all series are brought for the shape of the field
SHAPES = np.arange(0.0, 0.31, 0.03)
SCALES = 0.05 * 1.03 ** np.arange(140)


@dataclass(frozen=True)
class SpikeRules:
    threshold: float = 0.90  # quantile of the residuals above which the tail is fitted
    risk: float = 1e-7  # accepted chance of a good reading beyond the cutoff
    shortest: int = 6  # longest run that is never stuck
    stretch: float = 2.0


def impossible(value: Column) -> Column:
    """Non-finite."""
    return F.isnan(value) | (F.abs(value) == F.lit(float("inf")))


def filler(value: Column) -> Column:
    """A power of ten from a million on, or one made of nines only (with or without cents): no measurement but a stand-in."""
    size = F.abs(value)
    power = F.pow(F.lit(10.0), F.ceil(F.log10(size)))
    return F.coalesce((size >= 999_000) & ((power - size).isin(0.0, 1.0) | (F.abs(power - size - 0.01) < 0.004)), F.lit(False))


# ---- residuals


def running_level(neighbours: int = 7) -> Column:
    """The centred running median of value in (field, series, block), in order of (at, row_id)."""
    return F.percentile("value", 0.5).over(Window.partitionBy("field", "series", "block").orderBy("at", "row_id").rowsBetween(-neighbours, neighbours))


def local_residuals(readings: DataFrame, neighbours: int = 7) -> DataFrame:
    """(field, series, at, row_id, residual): distance from the centred running median of (field, series, block, at, row_id, value)."""
    return readings.select("field", "series", "at", "row_id", (F.col("value") - running_level(neighbours)).alias("residual"))


def _levels(rows: DataFrame, value: str, part: Column, sets: list[list[str]]) -> DataFrame:
    timed = rows.select("field", "series", part.alias("part"), F.col(value).alias("v"))
    return timed.groupingSets(sets, "field", "series", "part").agg(F.grouping("part").alias("whole"), F.percentile_approx("v", 0.5, ACCURACY).alias("level"), F.count("*").alias("n"))


def monthly_residuals(readings: DataFrame) -> DataFrame:
    """readings with residual: distance from the series' median in the month; from that of the whole series where the month
    has fewer than LEAST_SEASON readings or is unknown. All medians come from one aggregation."""
    month = F.coalesce(F.date_trunc("month", "at"), F.lit("1970-01-01").cast("timestamp"))
    levels = cut(_levels(readings, "value", month, [["field", "series", "part"], ["field", "series"]]))
    usual = levels.where("whole = 1").select("field", "series", F.col("level").alias("usual"))
    known = (F.col("n") >= LEAST_SEASON) & (F.col("part") > F.lit("1970-01-01").cast("timestamp"))
    level = levels.where("whole = 0").join(usual, ["field", "series"]).select("field", "series", "part", F.when(known, F.col("level")).otherwise(F.col("usual")).alias("level"))
    joined = readings.withColumn("part", month).join(level, ["field", "series", "part"])
    return joined.withColumn("residual", F.col("value") - F.col("level")).drop("part", "level")


def _weekday() -> Column:
    return F.coalesce(F.dayofweek("at"), F.lit(0))


def _of_field(rules: dict[str, SpikeRules], name: str) -> Column:
    chosen = F.lit(None).cast("double")
    for field, rule in rules.items():
        chosen = F.when(F.col("field") == field, float(getattr(rule, name))).otherwise(chosen)
    return chosen


def deseasoned(residuals: DataFrame) -> DataFrame:
    """residuals (field, series, at, ...) less the median of the series on that day of the week, where it has readings enough."""
    days = _levels(residuals.where("at is not null"), "residual", _weekday(), [["field", "series", "part"]])
    effect = days.where(F.col("n") >= LEAST_SEASON).select("field", "series", F.col("part").alias("weekday"), F.col("level").alias("effect"))
    joined = residuals.withColumn("weekday", _weekday()).join(cut(effect), ["field", "series", "weekday"], "left")
    return joined.withColumn("residual", F.col("residual") - F.coalesce("effect", F.lit(0.0))).drop("weekday", "effect")


# ---- tails

_SHAPE, _SCALE = (x.ravel() for x in np.meshgrid(SHAPES, SCALES))
_SAFE = np.where(_SHAPE > 0, _SHAPE, 1.0)


def _density(y: np.ndarray) -> np.ndarray:
    """Logarithms of the generalised Pareto densities of all shapes and scales (columns) at y (rows)."""
    y = y[:, None]
    return -np.log(_SCALE) - np.where(_SHAPE > 0, (1 / _SAFE + 1) * np.log1p(_SHAPE * y / _SCALE), y / _SCALE)


def _beyond(y: float) -> np.ndarray:
    return np.where(_SHAPE > 0, (1 + _SHAPE * y / _SCALE) ** (-1 / _SAFE), np.exp(-y / _SCALE))


def _quantile(at: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """What the tails with these numbers exceed once in so many exceedances."""
    shape, scale, safe = _SHAPE[at], _SCALE[at], _SAFE[at]
    return np.where(shape > 0, scale / safe * (odds**shape - 1), scale * np.log(odds))


def likelihoods(counts: np.ndarray, fence: float) -> np.ndarray:
    """Log likelihoods of all shapes and scales (columns) for histograms of exceedances (rows) truncated at the fence."""
    bins = max(1, min(BINS, round(fence / WIDTH)))
    seen = counts[:, :bins]
    return seen @ _density((np.arange(bins) + 0.5) * WIDTH) - seen.sum(1)[:, None] * np.log1p(-_beyond(bins * WIDTH))


@dataclass(frozen=True)
class FieldTail:
    """What the series of a field share: the shape, the fence, and how their exceedances spread."""

    shape: float
    fence: float
    spread: np.ndarray


def _tail(counts: np.ndarray) -> tuple[float, float]:
    """(shape, fence) of a histogram; the fence starts at four times the scale its median shows."""
    fence, at = 4 * (np.searchsorted(np.cumsum(counts), counts.sum() / 2) + 0.5) * WIDTH / np.log(2), 0
    for _ in range(12):
        at = int(likelihoods(counts[None, :], fence).argmax())
        last, fence = fence, float(_quantile(np.array(at), np.array(1 / FENCE)))
        if abs(fence - last) < WIDTH:
            break
    return float(_SHAPE[at]), fence


def field_tail(counts: np.ndarray, alike: np.ndarray) -> FieldTail:
    """From the exceedances of all series of a field as they are, and brought to the same median."""
    return FieldTail(_tail(alike)[0], _tail(counts)[1], counts / max(1.0, counts.sum()))


def _fitted(tails: dict[str, FieldTail], rules: dict[str, SpikeRules]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = np.array(batch.column("field").to_pylist(), object)
            odds = batch.column("over").to_numpy() / batch.column("n").to_numpy()
            bins = batch.column("bins")
            owner = np.repeat(np.arange(batch.num_rows), bins.value_lengths().to_numpy(zero_copy_only=False))
            cutoffs = np.zeros(batch.num_rows)
            places, counts = (bins.flatten().field(k).to_numpy() for k in (0, 1))
            for name, tail in tails.items():
                rows = np.flatnonzero(fields == name)
                if not len(rows):
                    continue
                place = np.full(batch.num_rows, -1)
                place[rows] = np.arange(len(rows))
                mine = (place[owner] >= 0) & (places < BINS)
                seen = np.tile(PRIOR * tail.spread, (len(rows), 1))
                np.add.at(seen, (place[owner[mine]], places[mine]), counts[mine])
                ways = likelihoods(seen, tail.fence)
                ways[:, _SHAPE != tail.shape] = -np.inf
                cutoffs[rows] = np.clip(1 + _quantile(ways.argmax(1), np.maximum(1.0, odds[rows] / rules[name].risk)), LOWEST, HIGHEST)
            yield pa.RecordBatch.from_arrays([batch.column("field"), batch.column("series"), pa.array(cutoffs)], ["field", "series", "cutoff"])

    return fit


def thresholds(residuals: DataFrame, rules: dict[str, SpikeRules]) -> DataFrame:
    """(field, series, u, n): the threshold of every series that varies. A series too short for its field's quantile (fewer
    than five readings beyond) has the lowest one."""
    size, levels = F.abs("residual"), sorted({rule.threshold for rule in rules.values()})
    at = lambda value: F.percentile_approx(value, F.array(*map(F.lit, levels)), ACCURACY)
    found = residuals.groupBy("field", "series").agg(at(size).alias("all"), at(F.when(size > 0, size)).alias("some"), F.count("*").alias("n"))
    chosen = F.lit(0)
    for field, rule in rules.items():
        chosen = F.when((F.col("field") == field) & (F.col("n") * (1 - rule.threshold) >= 5), levels.index(rule.threshold)).otherwise(chosen)
    u = F.coalesce(F.nullif(F.get("all", chosen), F.lit(0.0)), F.get("some", chosen))
    return found.select("field", "series", u.alias("u"), "n").where("u > 0")


def tail_cutoffs(exceedances: DataFrame, known: DataFrame, rules: dict[str, SpikeRules]) -> DataFrame:
    """(field, series, cutoff), in thresholds, from (field, series, y) and (field, series, u, n)."""
    place = F.least(F.floor(F.col("y") / WIDTH), F.lit(BINS)).cast("int").alias("bin")
    counted = cut(exceedances.groupBy("field", "series", place).agg(F.count("*").alias("k")))
    middles = counted.groupBy("field", "series").agg((F.percentile("bin", F.lit(0.5), F.col("k")) + 0.5).alias("middle"))
    alike = F.floor((F.col("bin") + 0.5) / F.col("middle") * MEDIAN / WIDTH).cast("int")
    both = counted.join(middles, ["field", "series"]).select("field", "k", F.explode(F.array(F.struct(F.lit(0).alias("kind"), "bin"), F.struct(F.lit(1).alias("kind"), alike.alias("bin")))).alias("b"))
    pooled: dict[str, np.ndarray] = {}
    for row in both.where(F.col("b.bin") < BINS).groupBy("field", "b.kind", "b.bin").agg(F.sum("k").alias("k")).collect():  # 2 BINS rows a field
        pooled.setdefault(row["field"], np.zeros((2, BINS)))[row["kind"], row["bin"]] = row["k"]
    tails = {name: field_tail(*counts) for name, counts in pooled.items()}
    by_series = counted.groupBy("field", "series").agg(F.sum("k").alias("over"), F.collect_list(F.struct("bin", F.col("k").cast("double").alias("k"))).alias("bins"))
    rows = by_series.join(known.select("field", "series", "n"), ["field", "series"]).select("field", "series", "over", "n", "bins")
    return rows.mapInArrow(_fitted(tails, rules), "field string, series string, cutoff double")


def spikes(residuals: DataFrame, rules: dict[str, SpikeRules]) -> DataFrame:
    """(field, row_id) of the readings beyond the cutoff of their series, from (field, series, at, row_id, residual)."""
    seasonless = deseasoned(residuals)
    known = cut(thresholds(seasonless, rules))
    over = F.abs("residual") / F.col("u") - 1
    exceedances = cut(seasonless.join(known, ["field", "series"]).where(over > 0).select("field", "series", "row_id", over.alias("y")))
    cutoffs = tail_cutoffs(exceedances, known, rules)
    return exceedances.join(cutoffs, ["field", "series"]).where(F.col("y") + 1 > F.col("cutoff")).select("field", "row_id")


# ---- runs


def stuck(readings: DataFrame, rules: dict[str, SpikeRules]) -> DataFrame:
    """(field, row_id) of all but the first reading of every stuck run."""
    return stuck_rows(islands(readings), rules)


def stuck_rows(marked: DataFrame, rules: dict[str, SpikeRules]) -> DataFrame:
    """The same from readings whose runs are marked."""
    lengths = runs(marked)
    usual = lengths.where("not goes_on").groupBy("field", "series").agg(F.least(F.percentile_approx("run", RUN_QUANTILE, ACCURACY), RUN_REACH * F.percentile_approx("run", 0.5, ACCURACY)).alias("usual"))
    longest = F.greatest(_of_field(rules, "shortest"), _of_field(rules, "stretch") * F.col("usual"))
    long = lengths.where(F.col("run") > _of_field(rules, "shortest")).join(usual, ["field", "series"]).where(F.col("run") > longest)
    found = marked.join(cut(long.select("field", "series", "block", "island", "goes_on")), ["field", "series", "block", "island"])
    return found.where(~F.col("opens") | F.col("goes_on")).select("field", "row_id")

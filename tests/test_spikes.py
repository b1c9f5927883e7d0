import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from outcomelens.operators import runs, spikes
from outcomelens.plans import quality

START = datetime(2025, 1, 1)


def readings(spark, values, field="v", series="s", block_hours=24):
    rows = [(field, series, (START + timedelta(hours=h)).timetuple().tm_yday * 24 // block_hours, START + timedelta(hours=h), h, v) for h, v in enumerate(values)]
    return spark.createDataFrame(rows, "field string, series string, block bigint, at timestamp, row_id bigint, value double")


def test_runs_do_not_depend_on_blocks(spark):
    rng, values = random.Random(1), []
    while len(values) < 300:
        values += [float(rng.randrange(3))] * rng.choice([1, 1, 2, 7, 30])
    expected, k = {}, 0
    while k < len(values):
        n = next((j for j in range(k, len(values)) if values[j] != values[k]), len(values)) - k
        expected[k] = n
        k += n
    for hours in (1, 5, 24, 10_000):
        found = runs.runs(runs.islands(readings(spark, values, block_hours=hours))).where("not goes_on")
        assert sorted(r.run for r in found.collect()) == sorted(expected.values())


def test_stuck_runs_but_not_usual_ones(spark):
    rng = random.Random(2)
    values = [rng.random() for _ in range(50)] + [5.0] * 12 + [rng.random() for _ in range(50)]
    rules = {"v": spikes.SpikeRules()}
    assert sorted(r.row_id for r in spikes.stuck(readings(spark, values), rules).collect()) == list(range(51, 62))
    steps = [float(k // 5) for k in range(200)]  # always five in a row
    assert spikes.stuck(readings(spark, steps), rules).count() == 0


def test_spikes_but_not_lasting_levels(spark):
    rng = random.Random(4)
    values = [10 + rng.gauss(0, 0.1) for _ in range(100)] + [30 + rng.gauss(0, 0.1) for _ in range(100)]
    values[40], values[150], values[151] = 60.0, -20.0, -20.0
    rows = readings(spark, values, block_hours=10_000)
    found = spikes.spikes(spikes.local_residuals(rows), {"v": spikes.SpikeRules()})
    assert sorted(r.row_id for r in found.collect()) == [40, 150, 151]


def test_constant_and_empty_series(spark):
    rules = {"v": spikes.SpikeRules()}
    flat = readings(spark, [1.0] * 5, block_hours=10_000)
    assert spikes.spikes(spikes.local_residuals(flat), rules).count() == 0
    assert spikes.spikes(spikes.local_residuals(flat.limit(0)), rules).count() == 0 and spikes.stuck(flat.limit(0), rules).count() == 0


def test_fillers(spark):
    values = [1e9, 999999999.0, -99999999.0, 9999999.99, 1234567.0, 99.99, 0.0, 2500000.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("f", spikes.filler(F.col("v")))
    assert [r.f for r in df.collect()] == [True, True, True, True, False, False, False, False]


def test_whole_query_on_dirty_rows(spark, write):
    rng, bars, events = random.Random(6), [], []
    for i in range(120):
        bars.append((i, "S", (START + timedelta(days=i)).date(), 100 + rng.random(), 1000 + rng.randrange(50)))
    for i, (close, volume) in {7: (0.0, 1), 30: (900.0, 1005), 60: (float("nan"), -5), 80: (None, None)}.items():
        bars[i] = (i, "S", bars[i][2], close, volume)
    bars += [(200, None, START.date(), 5.0, 5), (201, "S", None, float("inf"), 7)]
    for i in range(300):
        events.append((i, f"e{i}", "st", START + timedelta(hours=i), round(rng.gauss(0, 10), 2)))
    events[50] = (50, "e50", "st", events[50][3], 99999.0)
    events += [(400, " E50", "st", START, 99999.0), (401, "e401", None, START, float("inf")), (402, None, "st", None, 1e9), (403, "e403", "st", None, None)]
    extra = lambda df: df.withColumn("key", F.lit("x")).withColumn("field", F.lit(1)).withColumn("value", F.lit(2)).withColumn("series", F.lit(3))
    folder = write(
        outcomes_clusters=extra(spark.createDataFrame(bars, "row_id bigint, symbol string, date date, close double, volume bigint")),
        events_synthetic=extra(spark.createDataFrame(events, "row_id bigint, event_id string, strategy_id string, timestamp timestamp, realized_pnl double")),
    )
    found = {(r.tab, r.row_id, r.field) for r in quality.p5_found(spark, folder).collect()}
    bar, event = "outcomes_clusters", "events_synthetic"
    assert found == {(bar, 7, "close"), (bar, 7, "volume"), (bar, 30, "close"), (bar, 60, "close"), (bar, 60, "volume"), (bar, 201, "close"),
                     (event, 50, "realized_pnl"), (event, 400, "realized_pnl"), (event, 401, "realized_pnl"), (event, 402, "realized_pnl")}


def test_stuck_runs_of_short_and_mostly_frozen_series(spark):
    rng, rules = random.Random(8), {"v": spikes.SpikeRules()}
    short = [rng.random() for _ in range(9)] + [5.0] * 60 + [rng.random() for _ in range(9)]
    assert sorted(r.row_id for r in spikes.stuck(readings(spark, short), rules).collect()) == list(range(10, 69))
    frozen, expected = [], []
    for k in range(6):
        frozen += [rng.random() for _ in range(15)] + [float(k + 2)] * 12
        expected += range(len(frozen) - 11, len(frozen))
    assert sorted(r.row_id for r in spikes.stuck(readings(spark, frozen), rules).collect()) == expected
    half = [float(k // 2 + 2) if k % 41 else rng.random() for k in range(41)] + [7.0]
    assert spikes.stuck(readings(spark, half), rules).count() == 0
    assert spikes.stuck(readings(spark, [5.0] * 60), rules).count() == 0  # nothing else is known of it


def pareto(rng, shape, scale, n):
    u = rng.random(n)
    return scale * -np.log(u) if shape == 0 else scale / shape * (u**-shape - 1)


def histogram(y):
    return np.bincount(np.minimum((y / spikes.WIDTH).astype(int), spikes.BINS), minlength=spikes.BINS + 1)[: spikes.BINS].astype(float)


def test_tails_are_recovered_in_spite_of_spikes():
    rng = np.random.default_rng(1)
    for shape, scale in ((0.0, 0.3), (0.0, 0.8), (0.15, 0.3), (0.24, 0.3)):
        y = np.concatenate([pareto(rng, shape, scale, 20_000), rng.uniform(8, 12, 1500)])
        tail = spikes.field_tail(histogram(y), histogram(y))
        assert abs(tail.shape - shape) <= 0.06, (shape, tail.shape)
        ways = spikes.likelihoods(histogram(y)[None, :], tail.fence)[0]
        assert abs(spikes._SCALE[ways.argmax()] / scale - 1) < 0.12


def test_cutoffs_follow_the_tail_of_each_series(spark):
    """Three series with the same spread in the middle and other tails: a reading is a spike in one and none in another."""
    rng = np.random.default_rng(2)
    rows, k = [], 0
    for series, scale in (("short", 0.1), ("usual", 0.3), ("long", 0.9)):
        body = rng.uniform(-1, 1, 1800)
        tail = (1 + pareto(rng, 0.0, scale, 200)) * rng.choice([-1, 1], 200)
        for v in [*body, *tail, 4.5]:
            rows.append(("v", series, START + timedelta(hours=k), k, float(v)))
            k += 1
    df = spark.createDataFrame(rows, "field string, series string, at timestamp, row_id bigint, residual double")
    rules = {"v": spikes.SpikeRules(risk=1e-5)}
    found = {r.row_id for r in spikes.spikes(df, rules).collect()}
    assert {2000} <= found and 6002 not in found and len(found) <= 3
    strict = {r.row_id for r in spikes.spikes(df, {"v": spikes.SpikeRules(risk=1e-12)}).collect()}
    assert strict < found | {-1} and len(strict) <= len(found)


def test_days_of_the_week_are_a_season(spark):
    """A series that is ten times higher on Mondays: its Mondays are no spikes, the same value on a Tuesday is one."""
    rng = random.Random(12)
    rows = []
    for k in range(500):
        at = START + timedelta(days=k)
        value = (10.0 if at.weekday() == 0 else 0.0) + rng.gauss(0, 0.1)
        rows.append(("v", "s", at, k, 10.0 if k == 251 else value))
    assert (START + timedelta(days=251)).weekday() != 0
    df = spark.createDataFrame(rows, "field string, series string, at timestamp, row_id bigint, residual double")
    assert [r.row_id for r in spikes.spikes(df, {"v": spikes.SpikeRules()}).collect()] == [251]


def test_half_of_all_rows_in_one_series(spark):
    rng = random.Random(13)
    rows = [("v", "hot" if k % 2 else f"s{k % 20}", START + timedelta(minutes=k), k, rng.gauss(0, 1)) for k in range(4000)]
    rows[1001] = (*rows[1001][:4], 500.0)
    df = spark.createDataFrame(rows, "field string, series string, at timestamp, row_id bigint, residual double")
    assert [r.row_id for r in spikes.spikes(df, {"v": spikes.SpikeRules()}).collect()] == [1001]

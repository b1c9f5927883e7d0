import random
from collections import defaultdict
from datetime import date, datetime, timedelta

from outcomelens.operators import rolling


def brute(rows):
    days = defaultdict(lambda: defaultdict(int))
    for e, t, v in rows:
        if e is not None and t is not None:
            ok = v is not None and v == v and abs(v) != float("inf")
            days[e][t.date()] += round(v * 100) if ok else 0
    out = {}
    for e, by in days.items():
        day = min(by)
        while day <= max(by):
            total = lambda n: sum(by.get(day - timedelta(k), 0) for k in range(n))  # noqa: E731, B023
            out[e, day] = (total(7), total(30))
            day += timedelta(1)
    return out


def test_totals_match_brute_force(spark):
    rng, rows = random.Random(3), []
    for i in range(600):
        e = rng.choice(["a", "b", "hot", "hot", "hot", None])
        t = None if rng.random() < 0.05 else datetime(2025, 1, 1) + timedelta(days=rng.choice([0, 1, 2, 3, 40, 41, 100, 131, 160]), hours=rng.randrange(24))
        rows.append((e, t, rng.choice([1.25, -3.5, 0.1, None, float("nan"), float("inf"), -0.0, 1e9])))
    df = spark.createDataFrame(rows, "entity string, t timestamp, v double")
    got = {(r.entity, r.day): (round(r.total_7 * 100), round(r.total_30 * 100)) for r in rolling.rolling_totals(df, "entity", "t", "v").collect()}
    assert got == brute(rows)


def test_single_day_null_amounts_and_empty(spark):
    df = spark.createDataFrame([("x", datetime(2025, 3, 1), None), ("x", datetime(2025, 3, 1), None)], "entity string, t timestamp, v double")
    assert [tuple(r)[:3] for r in rolling.rolling_totals(df, "entity", "t", "v").collect()] == [("x", date(2025, 3, 1), 0.0)]
    assert rolling.rolling_totals(df.limit(0), "entity", "t", "v").count() == 0

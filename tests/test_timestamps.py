import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import brute_timestamps as brute
from outcomelens.operators import timestamps

PRODUCERS = [("u", "UTC", "DMY"), ("b", "Europe/Brussels", "DMY"), ("n", "America/New_York", "MDY"), ("l", "Europe/London", "DMY"), ("k", "Asia/Kolkata", "DMY"), ("s", "Australia/Sydney", "MDY"), ("h", "Australia/Lord_Howe", "DMY")]
ODD = [None, "", " ", "-", "pending", "T12:30:00Z", "2026-06-", "0000-00-00 00:00:00", "2025-02-29T10:00:00Z", "2024-02-29T10:00:00Z", "2025-13-04T08:00:00+00:00", "31/02/2026 11:00:00",
       "2025-03-30 02:30:00", "2025-10-26 02:30:00", "2025-10-26 02:30:00 CET", "2025-10-26 02:30:00 CEST", "2025-07-01 12:00:00 CET", "26/10/25 1:04 AM", "11/2/25 1:10 AM", "2025-366T00:00:00Z",
       "2024-366T00:00:00Z", "2025-W53-1T00:00:00Z", "2026-W53-7T00:00:00Z", "2025-W01-1T00:00:00Z", "20250231T000000Z", "20250301", "202503011230", "20250301123059", "1735691253832651111", "1735746292.019676",
       "99999999999999999999", "12345", "Fri, 01 Aug 2025 00:41:41 +0530", "Thu, 01 Aug 2025 00:41:41 +0530", "1 mei 2025 03:03:12", "31 mrt 2026 23:20:16", "10-Apr-2025 01:07:52", "April 31, 2025 01:50:31",
       "2025-06-06 03:40:48 PM", "2025-06-06 13:40:48 PM", "2025-06-06 12:00:00 AM", "2025-01-01t03:42:18z", "2025-01-01T00:25:26.076800818Z", "2025-01-01T05:45:52,414+00", " \t2025-01-01T05:45:52\r",
       "2024-12-31T19:27:21-05:00[America/New_York]", "01.04.2025 17:51", "2025-01-01 05:44:23 UTC", "2025-01-01 05:44:23 GMT", "2025-06-01 05:44:23 BST", "9" * 4000, "2025-04-06 01:45:00", "x" * 100_000]


def random_texts(n):
    rng, out = random.Random(5), []
    for _ in range(n):
        name, zone, order = rng.choice(PRODUCERS)
        moment = datetime(2025, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=rng.randrange(0, 46_000_000), microseconds=rng.randrange(10**6))
        there = moment.astimezone(ZoneInfo(zone))
        form = rng.choice(["%Y-%m-%dT%H:%M:%S.%fZ", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S%z", "slash", "%d.%m.%Y %H:%M", "%Y-%jT%H:%M:%S", "%G-W%V-%uT%H:%M:%S", "%d-%b-%Y %H:%M:%S", "%B %d, %Y %H:%M:%S", "%Y%m%d%H%M%S", "%I:%M", "epoch", "%Y-%m-%d %H:%M:%S %Z"])
        if form == "slash":
            form = "%d/%m/%Y %H:%M:%S" if order == "DMY" else "%m/%d/%Y %H:%M:%S"
        text = str(int(moment.timestamp() * 10 ** rng.choice([0, 3, 6]))) if form == "epoch" else there.strftime(form)
        out.append((name, text))
    return out


def test_interpretations_match_brute_force(spark):
    texts = [(p[0], t) for p in PRODUCERS for t in ODD] + [(None, t) for t in ODD] + [("unknown", t) for t in ODD[:20]] + random_texts(700)
    rows = [("t", i, "f", p, t) for i, (p, t) in enumerate(texts)]
    df = spark.createDataFrame(rows, "tab string, row_id bigint, field string, producer string, text string")
    producers = spark.createDataFrame(PRODUCERS, "producer string, time_zone string, date_order string")
    zones = {p: (z, o) for p, z, o in PRODUCERS}
    got = {r.row_id: r for r in timestamps.normalised(df, producers).collect()}
    assert len(got) == len(rows)
    for _, i, _, p, t in rows:
        expected = brute.read(t, *zones.get(p, (None, None)))
        assert got[i].certain == (len(expected) == 1), (p, t, expected, got[i])
        if len(expected) == 1:
            assert got[i].utc_us == next(iter(expected)), (p, t)


def test_path_prefers_the_running_notation_and_forward_time():
    hour = 3_600_000_000
    codes = [[1], [200, 201], [200, 201], [1]]
    utcs = [[0], [hour, 900 * hour], [2 * hour, 1800 * hour], [3 * hour]]
    assert timestamps.cheapest_path(codes, utcs, [[0], [0, 0], [0, 0], [0]]) == [0, 0, 0, 0]
    assert timestamps.cheapest_path([[1, 2]], [[5, 6]], [[1.0, 0.0]]) == [1]
    # a repeated hour resolves to the earlier reading while time runs forward from there
    assert timestamps.cheapest_path([[0], [0, 0], [0]], [[10 * hour], [11 * hour, 12 * hour], [11 * hour + 5]], [[0], [0, 0], [0]]) == [0, 0, 0]


def test_empty(spark):
    df = spark.createDataFrame([], "tab string, row_id bigint, field string, producer string, text string")
    producers = spark.createDataFrame(PRODUCERS, "producer string, time_zone string, date_order string")
    assert timestamps.normalised(df, producers).count() == 0


def months_of_days(rng, n, step, start=datetime(2025, 1, 1, tzinfo=timezone.utc)):
    return [start + timedelta(minutes=step * k + rng.randrange(step)) for k in range(n)]


def undeclared(n, step=90):
    """(row_id, producer, text, true instant) of three sources that declare no order of dates: two write slash dates only, one
    mixes them with ISO."""
    rng, rows = random.Random(7), []
    for k, moment in enumerate(months_of_days(rng, n, step)):
        moment = moment.replace(second=0, microsecond=0)
        for j, (name, form) in enumerate((("dmy", "%d/%m/%Y %H:%M"), ("mdy", "%m/%d/%Y %H:%M"), ("mix", "%d/%m/%Y %H:%M" if rng.random() < 0.5 else "%Y-%m-%d %H:%M:%S"))):
            rows.append((3 * k + j, name, moment.strftime(form), int(moment.timestamp()) * 1_000_000))
    return rows


def test_undeclared_orders_are_chosen_by_the_path(spark, monkeypatch):
    rows = undeclared(1200)
    df = spark.createDataFrame([("t", i, "f", p, t) for i, p, t, _ in rows], "tab string, row_id bigint, field string, producer string, text string")
    producers = spark.createDataFrame([(p, "UTC", None) for p in ("dmy", "mdy", "mix")], "producer string, time_zone string, date_order string")
    true, results = {i: u for i, _, _, u in rows}, {}
    for chain in (10**6, 64, 7):
        monkeypatch.setattr(timestamps, "CHAIN", chain)
        results[chain] = {r.row_id: r for r in timestamps.normalised(df, producers).collect()}
    whole = results[10**6]
    two = [i for i, p, t, _ in rows if "/" in t and int(t[:2]) <= 12 and int(t[3:5]) <= 12 and t[:2] != t[3:5]]
    assert len(two) > 300 and sum(whole[i].utc_us == true[i] for i in two) / len(two) > 0.99
    assert not any(whole[i].certain for i in two)
    # the first of both readings would be wrong in many rows: it is the path that decides
    for chain in (64, 7):
        assert {i: r.utc_us for i, r in results[chain].items()} == {i: r.utc_us for i, r in whole.items()}


def test_blocks_do_not_change_the_path(spark, monkeypatch):
    """Long runs of ambiguous rows in blocks of three, one and all rows: paths of the same cost."""
    rng = random.Random(8)
    texts = [rng.choice(["%02d/%02d/2025 10:00" % (rng.randrange(1, 13), rng.randrange(1, 13)), "", "2025-%02d-03 10:00:00" % rng.randrange(1, 13)] if rng.random() < 0.2 else ["%02d/%02d/2025 10:00" % (rng.randrange(1, 13), rng.randrange(1, 13))]) for _ in range(150)]
    df = spark.createDataFrame([("t", i, "f", "x", t) for i, t in enumerate(texts)], "tab string, row_id bigint, field string, producer string, text string")
    producers = spark.createDataFrame([("x", "UTC", None)], "producer string, time_zone string, date_order string")

    def cost(found):
        path = [r for r in found if r.utc_us is not None]
        ways = [timestamps.steps([{"notation": a.notation, "utc_us": a.utc_us, "cost": 0.0}], [{"notation": b.notation, "utc_us": b.utc_us, "cost": 0.0}])[0, 0] for a, b in zip(path, path[1:])]
        return sum(ways)

    costs = []
    for chain in (10**6, 3, 1):
        monkeypatch.setattr(timestamps, "CHAIN", chain)
        costs.append(cost(sorted(timestamps.normalised(df, producers).collect(), key=lambda r: r.row_id)))
    assert max(costs) - min(costs) < 1e-9

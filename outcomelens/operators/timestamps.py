"""Timestamps in many notations and zones, brought to UTC microseconds.

Every text yields an array of all its valid interpretations (notation, instant, cost), built from JVM expressions. A text
without zone is local time of its producer; local times that a clock change repeats give two instants, skipped ones none.
Slash dates are read both ways; where a producer declares its order, that is a fact, and the other costs more than any path
can make up. Of several interpretations a Viterbi pass over each source's record order picks one, with a penalty for a
change of notation and for a step back in time: this decides for producers that declare no order and for local times that a
clock change repeats. `certain` rows are those whose pick is the one instant that zone and declared order leave.

A source's records are cut into blocks of CHAIN arrivals, however large the source, without changing the path: the states
at the edges of a block are settled first. Where a row beside an edge has one interpretation, that is the state. Runs of
ambiguous rows that cross edges are settled by the cheapest costs between the first and the last row of each block they
touch, added up along the source, one small matrix a block; then every block is settled between its known ends.

Nulls, unusable texts, impossible dates or times, and local texts of an unknown producer have no interpretation (empty
array, null result). Digits beyond microseconds are cut off; parts not written are zero. Ties: the first interpretation.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from outcomelens.functions.identifiers import WHITE, identifier
from outcomelens.session import cut

CHAIN = 8192
SWITCH, BACK, MOST_BACK, WRONG_ORDER = 1.0, 0.25, 4.0, 50.0
DAY_US = 86_400_000_000
FIRST_UNIX, LAST_UNIX = 10**8, 4_102_444_800  # a bare number is a Unix time of 1973 to 2099 in some precision

#: Month names and their short forms in English, Dutch and German.
MONTHS = (
    "jan january januari januar", "feb february februari februar", "mar march maart mrt märz mär maerz", "apr april", "may mei mai", "jun june juni",
    "jul july juli", "aug august augustus", "sep sept september", "oct october oktober okt", "nov november", "dec december dezember dez",
)
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z\z"

_MARK = r"(?:\s*(Z|z|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5}))?(?:\[[A-Za-z_/+0-9-]+\])?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
NUMBERS = ("y", "mo", "d", "doy", "week", "wd", "h", "mi", "s", "a", "b", "unix")
PARTS = (*NUMBERS, "frac", "half", "mark", "month", "wday")
#: notation, pattern, the parts its groups hold in order
NOTATIONS = (
    ("iso", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[Tt ]{_CLOCK}(?:\s*([AaPp][Mm]))?{_MARK})?$", "y mo d h mi s frac half mark"),
    ("ordinal", rf"^(\d{{4}})-(\d{{3}})T{_CLOCK}{_MARK}$", "y doy h mi s frac mark"),
    ("week", rf"^(\d{{4}})-W(\d{{2}})-(\d)T{_CLOCK}{_MARK}$", "y week wd h mi s frac mark"),
    ("basic", rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}}){_MARK}$", "y mo d h mi s mark"),
    ("compact", r"^(?=\d{8}$|\d{12}$|\d{14}$)((?:19[7-9]|20)\d{1,2})(\d{2})(\d{2})(?:(\d{2})(\d{2})(\d{2})?)?$", "y mo d h mi s"),
    ("unix", r"^(\d{9,19})(?:\.(\d{1,9}))?$", "unix frac"),
    ("slash", r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})(?: (\d{1,2}):(\d{2})(?::(\d{2}))?(?: ([AaPp][Mm]))?)?$", "a b y h mi s half"),
    ("dot", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?: {_CLOCK})?$", "d mo y h mi s frac"),
    ("named", rf"^(?:([A-Za-z]{{3}}), )?(\d{{1,2}})[- ](\p{{L}}{{3,9}})\.?[- ](\d{{4}}) {_CLOCK}{_MARK}$", "wday d month y h mi s frac mark"),
    ("long", rf"^(\p{{L}}{{3,9}}) (\d{{1,2}}), (\d{{4}}) {_CLOCK}{_MARK}$", "month d y h mi s frac mark"),
)
CODE = {name: i for i, (name, _, _) in enumerate(NOTATIONS)}


@lru_cache(maxsize=1)
def _abbreviations() -> list[tuple[str, str, list[int]]]:
    """(zone, abbreviation, offsets in microseconds) by the rules of the time zone database, 1970 to 2037."""
    found: dict[tuple[str, str], set[int]] = {}
    moments = [datetime(y, m, 1, tzinfo=timezone.utc) for y in range(1970, 2038) for m in (1, 7)]
    for zone in sorted(available_timezones()):
        tz = ZoneInfo(zone)
        for moment in moments:
            there = moment.astimezone(tz)
            if (name := there.tzname()) and name.isalpha():
                found.setdefault((zone, name.upper()), set()).add(int(there.utcoffset().total_seconds()) * 1_000_000)
    return [(zone, name, sorted(offsets)) for (zone, name), offsets in found.items()]


def abbreviations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_abbreviations(), "zone string, mark string, offsets array<bigint>")


def _number(part: Column) -> Column:
    """Digits as a number. A failing try_cast costs an exception a row: empty parts must be null."""
    return part.try_cast("bigint")


_MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
_BEFORE = tuple(sum(_MONTH_DAYS[:k]) for k in range(12))


def _jan1(year: Column) -> Column:
    """Days from 1970 to the first day of a year."""
    return (year - 1970) * 365 + F.floor((year - 1969) / 4) - F.floor((year - 1901) / 100) + F.floor((year - 1601) / 400)


def _date(month: Column, day: Column) -> Column:
    """Days since 1970 of a date in the row's year (columns jan1, leap); null where there is no such date."""
    within = F.try_element_at(F.array(*map(F.lit, _MONTH_DAYS)), month.cast("int")) + F.when((month == 2) & F.col("leap"), 1).otherwise(0)
    before = F.try_element_at(F.array(*map(F.lit, _BEFORE)), month.cast("int")) + F.when((month > 2) & F.col("leap"), 1).otherwise(0)
    return F.when((month >= 1) & (month <= 12) & (day >= 1) & (day <= within), F.col("jan1") + before + day - 1)


def _monday(jan1: Column) -> Column:
    """Monday of the first ISO week: of the week that holds 4 January."""
    return jan1 + 3 - F.pmod(jan1 + 6, F.lit(7))


def _in_zone(local: Column, near: Column) -> Column:
    """The instant of a local time if the zone's offset at the given time holds."""
    return local - (F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(near), F.col("zone"))) - near)


def _instants(local: Column, early: Column, late: Column) -> Column:
    """The instants at which the zone's clock shows the local time: of the offsets a day before and after, those that hold
    then (always, where both are the same) and bear the written abbreviation, if there is one."""
    settled = early == late
    shows = lambda utc: F.when(settled, True).otherwise(F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc), F.col("zone"))) == local)
    named = lambda utc: (F.col("mark") == "") | F.coalesce(F.array_contains("offsets", local - utc), F.lit(False))
    return F.filter(F.array_distinct(F.array(early, late)), lambda utc: utc.isNotNull() & named(utc) & shows(utc))


def interpretations(rows: DataFrame, producers: DataFrame) -> DataFrame:
    """rows (tab, row_id, field, producer, text) with `candidates`, an array of (notation, utc_us, cost).

    Computed in stages, each on the columns of the one before, so that the generated code stays small."""
    zones = producers.select(identifier(F.col("producer")).alias("source"), F.col("time_zone").alias("zone"), F.col("date_order"))
    notation = F.lit(None).cast("int")
    spread = F.lit(None).cast("string")
    for name, pattern, groups in reversed(NOTATIONS):
        at = {part: f"${i}" for i, part in enumerate(groups.split(), 1)}
        layout = "|".join(at.get(part, "") for part in PARTS)
        notation = F.when(F.col("trimmed").rlike(pattern), CODE[name]).otherwise(notation)
        spread = F.when(F.col("notation") == CODE[name], F.regexp_replace("trimmed", pattern, layout)).otherwise(spread)
    keep = ["tab", "row_id", "field", "text", "source"]
    read = rows.withColumn("source", identifier(F.col("producer"))).select(*keep, F.btrim("text", F.lit(WHITE)).alias("trimmed"))
    read = read.withColumn("notation", notation).withColumn("parts", F.transform(F.split(spread, r"\|", -1), lambda p: F.nullif(p, F.lit(""))))

    part = lambda name: F.coalesce(F.get("parts", F.lit(PARTS.index(name))), F.lit(""))
    texts = [F.upper(part(n)).alias(n) for n in ("half", "mark", "month", "wday", "frac")]
    read = read.withColumn("numbers", F.transform(F.slice("parts", 1, len(NUMBERS)), _number))
    number = lambda name: F.get("numbers", F.lit(PARTS.index(name))).alias(name)
    read = read.select(*keep, "notation", *map(number, NUMBERS), *texts, F.length(part("y")).alias("y_width"), F.length(part("unix")).alias("digits"))
    read = read.join(zones, "source", "left").join(abbreviations(rows.sparkSession), ["zone", "mark"], "left")

    names = F.create_map(*[x for i, group in enumerate(MONTHS, 1) for name in group.split() for x in (F.lit(name.upper()), F.lit(i))])
    weekdays = F.create_map(*[x for i, name in enumerate(WEEKDAYS) for x in (F.lit(name.upper()), F.lit(i))])
    slash, coded = F.col("notation") == CODE["slash"], F.col("notation")
    year = F.col("y") + F.when(slash & (F.col("y_width") == 2), 2000).otherwise(0)
    h = F.coalesce("h", F.lit(0))
    hour = F.when(F.col("half") == "", h).when((h >= 1) & (h <= 12), h % 12 + F.when(F.col("half") == "PM", 12).otherwise(0))
    read = read.withColumns({
        "year": F.when(year >= 1, year), "hour": hour, "minute": F.coalesce("mi", F.lit(0)), "second": F.coalesce("s", F.lit(0)),
        "fraction": _number(F.rpad(F.substring("frac", 1, 6), 6, "0")), "mo": F.coalesce("mo", F.try_element_at(names, F.col("month")).cast("bigint")),
        "weekday": F.try_element_at(weekdays, F.col("wday")), "mdy": F.coalesce(F.col("date_order") == "MDY", F.lit(False)),
    })
    read = read.withColumns({
        "jan1": _jan1(F.col("year")), "next1": _jan1(F.col("year") + 1), "leap": ((F.col("year") % 4 == 0) & (F.col("year") % 100 != 0)) | (F.col("year") % 400 == 0),
        "clock": F.when((F.col("hour") < 24) & (F.col("minute") < 60) & (F.col("second") < 60), ((F.col("hour") * 60 + F.col("minute")) * 60 + F.col("second")) * 1_000_000 + F.col("fraction")),
        "month1": F.when(slash, F.when(F.col("mdy"), F.col("a")).otherwise(F.col("b"))).otherwise(F.col("mo")), "day1": F.when(slash, F.when(F.col("mdy"), F.col("b")).otherwise(F.col("a"))).otherwise(F.col("d")),
        "month2": F.when(slash, F.when(F.col("mdy"), F.col("b")).otherwise(F.col("a"))), "day2": F.when(slash, F.when(F.col("mdy"), F.col("a")).otherwise(F.col("b"))),
    })
    read = read.withColumns({"date1": _date(F.col("month1"), F.col("day1")), "date2": _date(F.col("month2"), F.col("day2"))})
    monday, weeks = _monday(F.col("jan1")), (_monday(F.col("next1")) - _monday(F.col("jan1"))) / 7
    of_week = F.when((F.col("week") >= 1) & (F.col("week") <= weeks) & F.col("wd").between(1, 7), monday + (F.col("week") - 1) * 7 + F.col("wd") - 1)
    of_year = F.when((F.col("doy") >= 1) & (F.col("doy") <= F.col("next1") - F.col("jan1")), F.col("jan1") + F.col("doy") - 1)
    same_weekday = (F.col("wday") == "") | (F.col("weekday") == F.pmod(F.col("date1") + 3, F.lit(7)))
    day = F.when(coded == CODE["ordinal"], of_year).when(coded == CODE["week"], of_week).when(same_weekday, F.col("date1"))
    read = read.withColumns({"local1": day * DAY_US + F.col("clock"), "local2": F.col("date2") * DAY_US + F.col("clock")})

    mark = F.col("mark")
    offset = F.rpad(F.regexp_replace(F.substring(mark, 2, 5), ":", ""), 4, "0")
    minutes = _number(F.substring(offset, 1, 2)) * 60 + _number(F.substring(offset, 3, 2))
    signed = F.when(F.startswith(mark, F.lit("-")), -minutes).otherwise(minutes) * 60_000_000
    utc_word = mark.isin("Z", "UTC") | ((mark == "GMT") & F.col("offsets").isNull())
    read = read.withColumn("fixed", F.when(mark.rlike("^[+-]"), signed).when(utc_word, 0).cast("bigint"))
    for k in (1, 2):
        # zone lookups are the dear part: none for texts with an offset of their own, two for most others
        read = read.withColumn(f"wall{k}", F.when(F.col("fixed").isNull(), F.col(f"local{k}")))
        local = F.col(f"wall{k}")
        read = read.withColumns({f"early{k}": _in_zone(local, local - DAY_US), f"late{k}": _in_zone(local, local + DAY_US)})
        exact = F.when(F.col("fixed").isNotNull() & F.col(f"local{k}").isNotNull(), F.array(F.col(f"local{k}") - F.col("fixed")))
        read = read.withColumn(f"instants{k}", F.coalesce(exact, _instants(local, F.col(f"early{k}"), F.col(f"late{k}"))))

    def candidates(utcs: Column, code: Column, cost: Column) -> Column:
        return F.transform(utcs, lambda utc: F.struct(code.cast("int").alias("notation"), utc.alias("utc_us"), cost.cast("double").alias("cost")))

    power = F.when(F.col("digits") <= 11, 0).when(F.col("digits") <= 14, 3).when(F.col("digits") <= 17, 6).otherwise(9)
    scaled = lambda by: F.call_function("div", F.col("unix"), F.lit(by))
    seconds = F.when(power == 0, F.col("unix")).when(power == 3, scaled(10**3)).when(power == 6, scaled(10**6)).otherwise(scaled(10**9))
    read = read.withColumns({"power": power, "seconds": seconds})
    plausible = (coded == CODE["unix"]) & (F.col("seconds") >= FIRST_UNIX) & (F.col("seconds") < LAST_UNIX) & ((F.col("frac") == "") | (F.col("power") == 0))
    unix, whole = F.col("unix"), F.col("power")
    micro = F.when(whole == 0, F.col("seconds") * 1_000_000 + F.col("fraction")).when(whole == 3, unix * 1000).when(whole == 6, unix).otherwise(scaled(1000))
    known_order = F.col("date_order").isin("DMY", "MDY")
    code1 = F.when(slash, F.when(F.col("mdy"), 201).otherwise(200)).otherwise(coded)
    code2 = F.when(F.col("mdy"), 200).otherwise(201)
    cost1 = F.when(slash & ~F.coalesce(known_order, F.lit(False)), WRONG_ORDER).otherwise(0.0)
    none = F.array().cast("array<bigint>")
    found = F.concat(
        candidates(F.coalesce("instants1", none), code1, cost1),
        candidates(F.coalesce("instants2", none), code2, F.lit(WRONG_ORDER)),
        candidates(F.when(plausible, F.array(micro)).otherwise(none), F.lit(100) + whole, F.lit(0.0)),
    )
    return read.select(*keep, found.alias("candidates"))


Options = list[dict]  # the interpretations of one row: notation, utc_us, cost


def steps(before: Options, after: Options) -> np.ndarray:
    """What it costs to go from each interpretation of a row to each of the next, the cost of the latter included."""
    codes, utcs, costs = ([np.array([c[k] for c in row]) for row in (before, after)] for k in ("notation", "utc_us", "cost"))
    back = np.log1p(np.maximum(0, utcs[0][:, None] - utcs[1][None, :]) / 1e6)
    return SWITCH * (codes[0][:, None] != codes[1][None, :]) + np.minimum(MOST_BACK, BACK * back) + costs[1][None, :]


def cheapest_path(codes: list[list[int]], utcs: list[list[int]], costs: list[list[float]]) -> list[int]:
    """Viterbi over rows that each have at least one interpretation: the index chosen in every row."""
    rows = [[{"notation": c, "utc_us": u, "cost": x} for c, u, x in zip(*row)] for row in zip(codes, utcs, costs)]
    best, back = np.array(costs[0], float), []
    for before, after in zip(rows, rows[1:]):
        ways = best[:, None] + steps(before, after)
        back.append(ways.argmin(0))
        best = ways.min(0)
    picks = [int(best.argmin())]
    for step in reversed(back):
        picks.append(int(step[picks[-1]]))
    return picks[::-1]


def _single(options: Options | None) -> bool:
    return options is not None and len(options) == 1


def _between(rows: list[Options]) -> np.ndarray:
    """The cheapest costs from each interpretation of the first row to each of the last."""
    costs = np.where(np.eye(len(rows[0]), dtype=bool), 0.0, np.inf)
    for before, after in zip(rows, rows[1:]):
        costs = (costs[:, :, None] + steps(before, after)[None, :, :]).min(1)
    return costs


_HERE = ["tab", "field", "source", "block"]
_CANDIDATES = "array<struct<notation:int,utc_us:bigint,cost:double>>"
_MATRIX = f"tab string, field string, source string, block bigint, first {_CANDIDATES}, last {_CANDIDATES}, open_before boolean, open_after boolean, costs array<double>"
_FORCED = "tab string, field string, source string, block bigint, first_pick int, last_pick int"


def _known(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(candidates, how many each row has, the rows that have any) of one block in order of arrival."""
    candidates = rows.column("candidates").combine_chunks()
    counts = candidates.value_lengths().fill_null(0).to_numpy()
    return candidates, counts, np.flatnonzero(counts > 0)


def _transfer(rows: pa.Table) -> pa.Table:
    """One block beside an open edge: the costs between the interpretations of its first and last row. Rows between two
    unambiguous ones cost the same whatever the ends are, and are left out."""
    rows = rows.sort_by("row_id")
    candidates, counts, known = _known(rows)
    anchors = np.flatnonzero(counts[known] == 1)
    first, last = (anchors[0] + 1, anchors[-1]) if len(anchors) else (len(known), len(known))
    at = lambda places: [candidates[int(i)].as_py() for i in places]
    head, tail = at(known[:first]), at(known[last:])
    costs = _between(head) if not tail else _between(head).min(1)[:, None] + _between(tail).min(0)[None, :]
    enter, leave = (rows.column(name)[0].as_py() for name in ("enter", "leave"))
    ends = head[0], (tail or head)[-1]
    costs = costs + np.array([c["cost"] for c in ends[0]])[:, None]
    if _single(enter):
        costs = costs + (steps(enter, ends[0])[0] - [c["cost"] for c in ends[0]])[:, None]
    if _single(leave):
        costs = costs + steps(ends[1], leave)[:, 0][None, :]
    row = {name: rows.column(name)[0].as_py() for name in [*_HERE, "open_before", "open_after"]} | {"first": ends[0], "last": ends[1], "costs": costs.ravel().tolist()}
    return _table([row], _MATRIX)


def _table(rows: list[dict], schema: str) -> pa.Table:
    options = pa.list_(pa.struct([("notation", pa.int32()), ("utc_us", pa.int64()), ("cost", pa.float64())]))
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), _CANDIDATES: options}
    return pa.Table.from_pylist(rows, pa.schema([(name, kinds[kind]) for name, kind in (part.split(" ") for part in schema.split(", "))]))


def _settle(rows: pa.Table) -> pa.Table:
    """The blocks of one source beside open edges, one row each: the picks at their ends on the cheapest path along them."""
    blocks, out, chain = rows.sort_by("block").to_pylist(), [], []
    for block in blocks:
        chain.append(block)
        if block["open_after"]:
            continue
        totals = np.zeros(len(chain[0]["first"]))
        marks = []
        for k, b in enumerate(chain):
            costs = np.array(b["costs"]).reshape(len(b["first"]), len(b["last"]))
            if k:  # the matrix of a block begins with the costs of its first row
                ways = totals[:, None] + steps(chain[k - 1]["last"], b["first"]) - [c["cost"] for c in b["first"]]
                enter, totals = ways.argmin(0), ways.min(0)
            else:
                enter = None
            ways = totals[:, None] + costs
            marks.append((enter, ways.argmin(0)))
            totals = ways.min(0)
        pick = int(totals.argmin())
        for b, (enter, through) in zip(reversed(chain), reversed(marks)):
            first = int(through[pick])
            out.append({name: b[name] for name in _HERE} | {"first_pick": first, "last_pick": pick})
            pick = int(enter[first]) if enter is not None else -1
        chain = []
    return _table(out, _FORCED)


_UNSURE = "tab string, row_id bigint, field string, text string, candidates " + _CANDIDATES + ", pick int"


def _chain(rows: pa.Table) -> pa.Table:
    """The ambiguous rows of one block: each run of them is settled between the unambiguous rows around it, the ends of the
    block between what its neighbours hold or as they were settled before."""
    rows = rows.sort_by("row_id")
    column = lambda name: rows.column(name).combine_chunks()
    counts, befores, afters = (column(name).value_lengths().fill_null(0).to_numpy() for name in ("candidates", "before", "after"))
    candidates, picks = column("candidates"), np.zeros(rows.num_rows, np.int32)
    enter, leave, first_pick, last_pick = (rows.column(name)[0].as_py() for name in ("enter", "leave", "first_pick", "last_pick"))
    for run in np.split(np.arange(rows.num_rows), np.flatnonzero(befores[1:] <= 1) + 1):
        options, shifts = [candidates[int(k)].as_py() for k in run], np.zeros(len(run), np.int32)
        head = rows.column("before")[int(run[0])].as_py() or enter
        tail = rows.column("after")[int(run[-1])].as_py() or leave
        if befores[run[0]] == 0 and first_pick is not None and counts[run[0]] > first_pick:
            options[0], shifts[0] = [options[0][first_pick]], first_pick
        if afters[run[-1]] == 0 and last_pick is not None and len(options[-1]) > last_pick:
            options[-1], shifts[-1] = [options[-1][last_pick]], last_pick
        head, tail = ([x] if _single(x) else [] for x in (head, tail))
        path = head + options + tail
        found = cheapest_path(*([[c[key] for c in row] for row in path] for key in ("notation", "utc_us", "cost")))
        picks[run] = shifts + np.array(found[len(head) : len(head) + len(run)], np.int32)
    kind = pa.list_(pa.struct([("notation", pa.int32()), ("utc_us", pa.int64()), ("cost", pa.float64())]))
    kept = [rows.column(name) for name in ("tab", "row_id", "field", "text")] + [candidates.cast(kind), pa.array(picks)]
    return pa.table(kept, ["tab", "row_id", "field", "text", "candidates", "pick"])


def normalised(rows: DataFrame, producers: DataFrame) -> DataFrame:
    """rows (tab, row_id, field, producer, text) with utc_us, its notation and `certain`: exactly one instant is declared, and
    it is the pick.

    A row without interpretation has nulls. Only ambiguous rows, with what lies before and after them, leave the JVM."""
    block = F.floor(F.col("row_id") / CHAIN).alias("block")
    read = cut(interpretations(rows, producers).select("tab", "field", F.coalesce("source", F.lit("")).alias("source"), block, "row_id", "text", "candidates"))
    known, size = read.where(F.size("candidates") > 0), F.size("candidates")
    ends = known.groupBy(*_HERE).agg(F.min_by("candidates", "row_id").alias("first"), F.max_by("candidates", "row_id").alias("last"))
    along = Window.partitionBy("tab", "field", "source").orderBy("block")
    many = lambda name: F.coalesce(F.size(name) > 1, F.lit(False))
    edges = ends.withColumns({"enter": F.lag("last").over(along), "leave": F.lead("first").over(along)})
    edges = cut(edges.withColumns({"open_before": many("enter") & many("first"), "open_after": many("last") & many("leave")}).drop("first", "last"))
    touched = known.drop("text").join(edges.where("open_before or open_after"), _HERE)
    forced = touched.groupBy(*_HERE).applyInArrow(_transfer, _MATRIX).groupBy("tab", "field", "source").applyInArrow(_settle, _FORCED)
    inside = Window.partitionBy(*_HERE).orderBy("row_id")
    beside = known.withColumn("text", F.when(size > 1, F.col("text"))).withColumns({"before": F.lag("candidates").over(inside), "after": F.lead("candidates").over(inside)})
    unsure = beside.where(size > 1).join(edges.join(forced, _HERE, "left").drop("open_before", "open_after"), _HERE)
    chosen = unsure.groupBy(*_HERE).applyInArrow(_chain, _UNSURE)
    settled = read.where(F.coalesce(size, F.lit(0)) <= 1).select("tab", "row_id", "field", "text", "candidates", F.when(size == 1, 0).otherwise(-1).alias("pick"))
    pick = F.get("candidates", F.col("pick"))
    declared = F.array_distinct(F.transform(F.filter("candidates", lambda c: c["cost"] < WRONG_ORDER), lambda c: c["utc_us"]))
    return settled.unionByName(chosen).select(
        "tab", "row_id", "field", "text", pick["utc_us"].alias("utc_us"), pick["notation"].alias("notation"),
        F.coalesce((F.size(declared) == 1) & (declared[0] == pick["utc_us"]), F.lit(False)).alias("certain"),
    )


def texts(rows: DataFrame, tab: str, field: str) -> DataFrame:
    return rows.select(F.lit(tab).alias("tab"), "row_id", F.lit(field).alias("field"), "producer", F.col(field).alias("text"))

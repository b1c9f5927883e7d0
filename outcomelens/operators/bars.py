"""Daily bars: validation, patterns and indicators, evaluated at every bar from trailing frames.

All frames of a symbol share one window (partition by symbol, order by date), so a scan is one exchange and one sort. A
frame that is not full, a missing volume or a constant window fails closed: not detected, confidence 0, reason set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from outcomelens.functions.exprs import clamp01, ratio


@dataclass(frozen=True)
class PatternRules:
    """Default windows and thresholds of the patterns."""

    consolidation: int = 10
    max_range: float = 5.0
    buffer: float = 0.0
    volume_window: int = 20
    volume_times: float = 2.0
    trend: int = 10
    consistency: float = 0.6
    lookback: int = 20
    z: float = 2.0
    gap: float = 2.0
    drawdown: float = 10.0
    recovery: float = 0.5


RULES = PatternRules()


def by_date():
    return Window.partitionBy("symbol").orderBy("date")


def frame(first: int, last: int = 0) -> Window:
    return by_date().rowsBetween(first, last)


def full(column: str, first: int, last: int = 0) -> Column:
    """Whether the frame holds as many values as it has places."""
    return F.count(column).over(frame(first, last)) == last - first + 1


def pct(now: Column, before: Column) -> Column:
    return (ratio(now, before) - 1) * 100


# ---- validation


def bar_errors() -> Column:
    """All rules a bar breaks, in order."""
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    good = lambda x: F.coalesce((x > 0) & (x < F.lit(float("inf"))), F.lit(False))
    rules = (
        (~good(o), "open_invalid"), (~good(h), "high_invalid"), (~good(lo), "low_invalid"), (~good(c), "close_invalid"), (h < lo, "high_below_low"),
        (good(o) & ~o.between(lo, h), "open_outside_range"), (good(c) & ~c.between(lo, h), "close_outside_range"), (v < 0, "volume_negative"),
        (F.col("date").isNull(), "date_missing"), (F.lag("date").over(by_date().orderBy("date", "row_id")) >= F.col("date"), "date_not_increasing"),
    )
    return F.array_compact(F.array(*[F.when(broken, name) for broken, name in rules]))


def checked(bars: DataFrame) -> DataFrame:
    return bars.withColumn("errors", bar_errors())


def bar_validation(bars: DataFrame) -> DataFrame:
    """Bars per symbol and broken rule; a symbol without errors has one row with an empty rule."""
    rows = checked(bars)
    broken = rows.select("symbol", F.explode("errors").alias("error")).groupBy("symbol", "error").agg(F.count("*").alias("bars"))
    clean = rows.groupBy("symbol").agg(F.sum(F.size("errors")).alias("n"), F.count("*").alias("bars")).where("n = 0").select("symbol", F.lit("").alias("error"), "bars")
    return broken.unionByName(clean)


def valid_bars(bars: DataFrame, strict: bool = False) -> DataFrame:
    """Bars without errors; strict: only of symbols that have none at all."""
    rows = checked(bars)
    if strict:
        whole = Window.partitionBy("symbol")
        rows = rows.withColumn("broken", F.sum(F.size("errors")).over(whole)).where("broken = 0").drop("broken")
    return rows.where(F.size("errors") == 0).drop("errors")


# ---- patterns: each yields (detected, confidence, reason) as a struct column


def _signal(ready: Column, detected: Column, confidence: Column, reason: Column | None = None) -> Column:
    short = F.when(~ready, "insufficient_bars") if reason is None else F.when(~ready, "insufficient_bars").otherwise(reason)
    ok = F.coalesce(ready & detected, F.lit(False)) if reason is None else F.coalesce(ready & detected & reason.isNull(), F.lit(False))
    return F.struct(ok.alias("detected"), F.when(ok, F.round(clamp01(confidence), 4)).otherwise(0.0).alias("confidence"), short.alias("reason"))


def breakout(r: PatternRules = RULES) -> Column:
    w = frame(-r.consolidation, -1)
    hi, lo = F.max("high").over(w), F.min("low").over(w)
    spread = (hi - lo) / ((hi + lo) / 2) * 100
    rise = pct(F.col("close"), hi)
    detected = (spread <= r.max_range) & (F.col("close") > hi * (1 + r.buffer / 100))
    return _signal(full("close", -r.consolidation, -1), detected, 0.5 * clamp01(1 - spread / r.max_range) + 0.5 * clamp01(rise / r.max_range))


def volume_spike(r: PatternRules = RULES) -> Column:
    w = frame(-r.volume_window, -1)
    base = F.avg("volume").over(w)
    times = ratio(F.col("volume"), base)
    bars_there = full("close", -r.volume_window, -1)
    missing = F.col("volume").isNull() | ~full("volume", -r.volume_window, -1)
    reason = F.when(missing, "volume_missing").when(base <= 0, "degenerate_baseline")
    return _signal(bars_there, times >= r.volume_times, times / (2 * r.volume_times), reason)


def trend(r: PatternRules = RULES) -> Column:
    move = F.col("close") - F.lag("close").over(by_date())
    net = F.col("close") - F.lag("close", r.trend).over(by_date())
    w = frame(-(r.trend - 1))
    ups, downs = F.sum("up").over(w) / r.trend, F.sum("down").over(w) / r.trend
    agrees = F.when(net > 0, (move > 0) & (ups >= r.consistency)).when(net < 0, ~(move > 0) & (downs >= r.consistency)).otherwise(False)
    return _signal(F.lag("close", r.trend).over(by_date()).isNotNull(), agrees, F.when(net > 0, ups).otherwise(downs))


def mean_reversion(r: PatternRules = RULES) -> Column:
    w = frame(-(r.lookback - 1))
    flat = F.min("close").over(w) == F.max("close").over(w)
    z = F.try_divide(F.col("close") - F.avg("close").over(w), F.nullif(F.stddev_pop("close").over(w), F.lit(0.0)))
    return _signal(full("close", -(r.lookback - 1)), F.abs(z) >= r.z, 0.5 + 0.5 * (F.abs(z) - r.z) / r.z, F.when(flat, "zero_variance"))


def gap(r: PatternRules = RULES) -> Column:
    before = F.lag("close").over(by_date())
    size = pct(F.col("open"), before)
    return _signal(before.isNotNull(), F.abs(size) >= r.gap, F.abs(size) / (2 * r.gap))


def gap_risk(r: PatternRules = RULES) -> Column:
    """Unfilled gap that closed in its own direction."""
    before = F.lag("close").over(by_date())
    size = pct(F.col("open"), before)
    up = (size >= r.gap) & (F.col("close") > F.col("open")) & (F.col("low") > before)
    down = (size <= -r.gap) & (F.col("close") < F.col("open")) & (F.col("high") < before)
    return F.coalesce(up | down, F.lit(False))


def failed_breakout(r: PatternRules = RULES) -> Column:
    base = F.max("high").over(frame(-(r.consolidation + 1), -2))
    before = F.lag("high").over(by_date())
    detected = (before > base) & (F.col("close") < base)
    size = pct(base, F.col("close")) + pct(before, base)
    return _signal(full("close", -(r.consolidation + 1), -2), detected, size / (2 * r.max_range))


def structure(r: PatternRules = RULES) -> Column:
    n = max(4, r.trend)
    half = n // 2
    first, second = frame(-(n - 1), -(n - half)), frame(-(n - half - 1))
    h1, h2, l1, l2 = F.max("high").over(first), F.max("high").over(second), F.min("low").over(first), F.min("low").over(second)
    detected = ((h2 > h1) & (l2 > l1)) | ((h2 < h1) & (l2 < l1))
    return _signal(full("close", -(n - 1)), detected, (F.abs(pct(h2, h1)) + F.abs(pct(l2, l1))) / (2 * r.max_range))


def _deepest(closes: Column) -> Column:
    """(peak, trough, drawdown) of the deepest fall from a running peak in an array of closes."""
    start = F.struct(closes[0].alias("top"), F.lit(0.0).alias("fall"), closes[0].alias("trough"), closes[0].alias("peak"))

    def step(acc: Column, close: Column) -> Column:
        top = F.greatest(acc["top"], close)
        fall = (close / top - 1) * 100
        deeper = fall < acc["fall"]
        pick = lambda new, old: F.when(deeper, new).otherwise(old)
        return F.struct(top.alias("top"), pick(fall, acc["fall"]).alias("fall"), pick(close, acc["trough"]).alias("trough"), pick(top, acc["peak"]).alias("peak"))

    return F.aggregate(closes, start, step)


def drawdown(r: PatternRules = RULES) -> Column:
    deep = F.col("deep")
    recovered = F.coalesce(F.try_divide(F.col("close") - deep["trough"], F.nullif(deep["peak"] - deep["trough"], F.lit(0.0))), F.lit(0.0))
    detected = (F.abs(deep["fall"]) >= r.drawdown) & (recovered >= r.recovery)
    return _signal(full("close", -(r.lookback - 1)), detected, 0.5 * clamp01(recovered) + 0.5 * clamp01(F.abs(deep["fall"]) / (2 * r.drawdown)))


PATTERNS = {
    "breakout_after_consolidation": breakout, "volume_spike": volume_spike, "trend_continuation": trend, "mean_reversion_candidate": mean_reversion,
    "gap_continuation_risk": gap, "failed_breakout": failed_breakout, "higher_high_higher_low": structure, "drawdown_recovery": drawdown,
}


def prepared(bars: DataFrame, r: PatternRules = RULES) -> DataFrame:
    """Bars with the steps that patterns sum or fold over their frames."""
    move = F.col("close") - F.lag("close").over(by_date())
    closes = F.collect_list("close").over(frame(-(r.lookback - 1)))
    return bars.withColumn("up", F.when(move > 0, 1).otherwise(0)).withColumn("down", F.when(move < 0, 1).otherwise(0)).withColumn("deep", _deepest(closes))


def pattern(bars: DataFrame, name: str, r: PatternRules = RULES) -> DataFrame:
    """One pattern at every bar: symbol, date, detected, confidence, reason."""
    return prepared(bars, r).withColumn("s", PATTERNS[name](r)).select("symbol", "date", "s.detected", "s.confidence", "s.reason")


def pattern_scan(bars: DataFrame, r: PatternRules = RULES) -> DataFrame:
    """All patterns at the last bar of every symbol, from one window pass."""
    last = F.lead("date").over(by_date()).isNull()
    signals = F.array(*[F.struct(F.lit(name).alias("pattern"), make(r).alias("s")) for name, make in PATTERNS.items()])
    rows = prepared(bars, r).select("symbol", "date", last.alias("last"), signals.alias("signals")).where("last")
    return rows.select("symbol", "date", F.explode("signals").alias("p")).select("symbol", "date", "p.pattern", "p.s.detected", "p.s.confidence", "p.s.reason")


# ---- what lies behind a verdict

#: Bars a pattern needs beyond its window, by the rule that names it, and whether it needs volumes.
NEEDS = {
    "breakout_after_consolidation": ("consolidation", 1, False), "volume_spike": ("volume_window", 1, True), "trend_continuation": ("trend", 1, False),
    "mean_reversion_candidate": ("lookback", 0, False), "gap_continuation_risk": (None, 2, False), "failed_breakout": ("consolidation", 2, False),
    "higher_high_higher_low": ("trend", 0, False), "drawdown_recovery": ("lookback", 0, False),
}
#: What is missing where a pattern fails closed.
MISSING = {"insufficient_bars": "bars", "volume_missing": "volume"}


def _measures(r: PatternRules) -> dict[str, list[tuple[str, int | None, Column]]]:
    """Per pattern (measure, digits, value); words and truth values have no digits."""
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    at, before = by_date(), F.lag("close").over(by_date())
    hi, low = F.max("high").over(frame(-r.consolidation, -1)), F.min("low").over(frame(-r.consolidation, -1))
    spread = (hi - low) / ((hi + low) / 2) * 100
    base = F.avg("volume").over(frame(-r.volume_window, -1))
    start = F.lag("close", r.trend).over(at)
    net, last_up = pct(c, start), c - before > 0
    moves = frame(-(r.trend - 1))
    w = frame(-(r.lookback - 1))
    mean, dev = F.avg("close").over(w), F.stddev_pop("close").over(w)
    z = F.try_divide(c - mean, F.nullif(dev, F.lit(0.0)))
    size = pct(o, before)
    up, down = size >= r.gap, size <= -r.gap
    with_gap = F.when(up, c > o).when(down, c < o).otherwise(False)
    filled = F.when(up, lo <= before).when(down, h >= before).otherwise(False)
    top, poke = F.max("high").over(frame(-(r.consolidation + 1), -2)), F.lag("high").over(at)
    n = max(4, r.trend)
    first, second = frame(-(n - 1), -(n - n // 2)), frame(-(n - n // 2 - 1))
    h1, h2, l1, l2 = F.max("high").over(first), F.max("high").over(second), F.min("low").over(first), F.min("low").over(second)
    deep = F.col("deep")
    fell = lambda x: F.when(deep["fall"] < 0, x)
    recovered = F.coalesce(F.try_divide(c - deep["trough"], F.nullif(deep["peak"] - deep["trough"], F.lit(0.0))), F.lit(0.0))
    return {
        "breakout_after_consolidation": [
            ("consolidation_high", 6, hi), ("consolidation_low", 6, low), ("consolidation_range_pct", 6, spread), ("consolidated", None, spread <= r.max_range),
            ("breakout_level", 6, hi * (1 + r.buffer / 100)), ("breakout_close", 6, c), ("breakout_pct", 6, pct(c, hi)),
        ],
        "volume_spike": [("last_volume", 6, v), ("baseline_volume", 6, base), ("ratio", 6, ratio(v, base))],
        "trend_continuation": [
            ("direction", None, F.when(net > 0, "up").when(net < 0, "down").otherwise("flat")), ("net_return_pct", 6, net), ("up_fraction", 4, F.sum("up").over(moves) / r.trend),
            ("down_fraction", 4, F.sum("down").over(moves) / r.trend), ("last_bar_move_up", None, last_up),
        ],
        "mean_reversion_candidate": [
            ("mean", 6, mean), ("stdev", 6, dev), ("last_close", 6, c), ("zscore", 4, z), ("deviation_pct", 6, pct(c, mean)),
            ("direction", None, F.when(z <= -r.z, "oversold_reversion_up").when(z >= r.z, "overbought_reversion_down").otherwise("none")),
        ],
        "gap_continuation_risk": [
            ("gap_pct", 6, size), ("direction", None, F.when(up, "gap_up").when(down, "gap_down").otherwise("none")), ("closed_in_gap_direction", None, with_gap), ("gap_filled", None, filled),
            ("continuation_risk", None, (up | down) & with_gap & ~filled), ("prev_close", 6, before), ("open", 6, o),
        ],
        "failed_breakout": [("base_high", 6, top), ("breakout_high", 6, poke), ("fail_close", 6, c), ("poke_pct", 6, pct(poke, top)), ("retrace_pct", 6, pct(top, c))],
        "higher_high_higher_low": [
            ("structure", None, F.when((h2 > h1) & (l2 > l1), "HH_HL").when((h2 < h1) & (l2 < l1), "LH_LL").otherwise("mixed")), ("first_half_high", 6, h1), ("second_half_high", 6, h2),
            ("first_half_low", 6, l1), ("second_half_low", 6, l2),
        ],
        "drawdown_recovery": [("peak", 6, fell(deep["peak"])), ("trough", 6, fell(deep["trough"])), ("max_drawdown_pct", 6, deep["fall"]), ("recovered_frac", 4, recovered), ("current_close", 6, c)],
    }


def pattern_evidence(bars: DataFrame, r: PatternRules = RULES) -> DataFrame:
    """The numbers and words behind every verdict at the last bar of every symbol, one row each: symbol, date, pattern, measure,
    number, word. A pattern that fails closed has none."""
    entry = lambda name, digits, value: F.struct(
        F.lit(name).alias("measure"),
        (F.lit(None).cast("double") if digits is None else F.round(value.cast("double"), digits)).alias("number"),
        (value.cast("string") if digits is None else F.lit(None).cast("string")).alias("word"),
    )
    parts = [F.struct(F.lit(name).alias("pattern"), PATTERNS[name](r)["reason"].alias("reason"), F.array(*[entry(*m) for m in measures]).alias("m")) for name, measures in _measures(r).items()]
    last = F.lead("date").over(by_date()).isNull()
    rows = prepared(bars, r).select("symbol", "date", last.alias("last"), F.array(*parts).alias("parts")).where("last")
    found = rows.select("symbol", "date", F.explode("parts").alias("p")).where("p.reason is null").select("symbol", "date", "p.pattern", F.explode("p.m").alias("e"))
    return found.select("symbol", "date", "pattern", "e.measure", "e.number", "e.word")


def pattern_signals(bars: DataFrame, r: PatternRules = RULES) -> DataFrame:
    """pattern_scan with what each pattern needs and misses. Every verdict is research only, and one that fails closed vouches
    for no real data. bars: with data_is_real."""
    needs = [F.when(F.col("pattern") == name, F.struct(F.lit(more + (getattr(r, rule) if rule else 0)).alias("min_bars"), F.lit(volume).alias("needs_volume"))) for name, (rule, more, volume) in NEEDS.items()]
    missing = F.coalesce(*[F.when(F.col("reason") == reason, what) for reason, what in MISSING.items()])
    real = bars.groupBy("symbol").agg(F.bool_and(F.coalesce("data_is_real", F.lit(False))).alias("real"))
    rows = pattern_scan(bars, r).join(real, "symbol").withColumn("needs", F.coalesce(*needs))
    return rows.select("symbol", "date", "pattern", "detected", "confidence", "reason", "needs.min_bars", "needs.needs_volume", missing.alias("missing_data"), F.lit(True).alias("research_only"), (F.col("real") & F.col("reason").isNull()).alias("data_is_real"))


# ---- indicators


def bollinger(bars: DataFrame, period: int = 20, k: float = 2.0) -> DataFrame:
    """Bands at every bar; a constant window fails closed but shows its middle, bands equal to it and no position."""
    w = frame(-(period - 1))
    mid, dev = F.avg("close").over(w), F.stddev_pop("close").over(w)
    flat = F.min("close").over(w) == F.max("close").over(w)
    rows = bars.select("symbol", "date", "close", full("close", -(period - 1)).alias("ready"), flat.alias("flat"), mid.alias("mid"), F.when(flat, 0.0).otherwise(dev).alias("dev"))
    width = 2 * k * F.col("dev")
    place = F.when(~F.col("flat"), F.try_divide(F.col("close") - (F.col("mid") - k * F.col("dev")), width))
    shown = lambda c, digits=6: F.round(F.when(F.col("ready"), c), digits)
    status = F.when(F.col("ready") & ~F.col("flat"), "OK").otherwise("FAIL_CLOSED")
    return rows.select(
        "symbol", "date", status.alias("status"), shown(F.col("mid")).alias("mid"), shown(F.col("mid") + k * F.col("dev")).alias("upper"),
        shown(F.col("mid") - k * F.col("dev")).alias("lower"), shown(place, 4).alias("percent_b"), shown(F.try_divide(width, F.nullif(F.col("mid"), F.lit(0.0)))).alias("bandwidth"),
    )


def volume_trend(bars: DataFrame, short: int = 5, long: int = 20) -> DataFrame:
    """Short against long mean of the volume at every bar; a missing volume in the long frame fails closed."""
    few, many = F.avg("volume").over(frame(-(short - 1))), F.avg("volume").over(frame(-(long - 1)))
    ready = full("volume", -(long - 1)) & (many > 0)
    times = F.try_divide(few, F.nullif(many, F.lit(0.0)))
    rows = bars.select("symbol", "date", ready.alias("ready"), few.alias("few"), many.alias("many"), times.alias("times"))
    shown = lambda c, digits=6: F.round(F.when(F.col("ready"), c), digits)
    direction = F.when(~F.col("ready"), "none").when(F.col("times") > 1, "rising").when(F.col("times") < 1, "falling").otherwise("flat")
    return rows.select("symbol", "date", shown(F.col("few")).alias("short_avg"), shown(F.col("many")).alias("long_avg"), shown(F.col("times"), 4).alias("ratio"), direction.alias("direction"))




def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Last value per symbol: the averages recur over the whole history of the symbol, folded once over its ordered closes
    (one value a day, so an array of a symbol's closes is bounded by its calendar)."""
    a, b, c = (2.0 / (n + 1.0) for n in (fast, slow, signal))
    closes = F.transform(F.array_sort(F.collect_list(F.struct("date", "close"))), lambda x: x["close"])
    null = F.lit(None).cast("double")

    def step(acc: Column, x: Column) -> Column:
        f = F.when(acc["f"].isNull(), x).otherwise(a * x + (1 - a) * acc["f"])
        s = F.when(acc["s"].isNull(), x).otherwise(b * x + (1 - b) * acc["s"])
        g = F.when(acc["g"].isNull(), f - s).otherwise(c * (f - s) + (1 - c) * acc["g"])
        return F.struct(f.alias("f"), s.alias("s"), g.alias("g"))

    folded = bars.groupBy("symbol").agg(closes.alias("closes")).withColumn("m", F.aggregate("closes", F.struct(null.alias("f"), null.alias("s"), null.alias("g")), step))
    ready = F.size("closes") >= slow + signal
    line = F.col("m.f") - F.col("m.s")
    shown = lambda x: F.round(F.when(F.col("ready"), x), 6)
    return folded.withColumn("ready", ready).select(
        "symbol", F.when(F.col("ready"), "OK").otherwise("FAIL_CLOSED").alias("status"), shown(line).alias("macd"), shown(F.col("m.g")).alias("signal"), shown(line - F.col("m.g")).alias("histogram")
    )


def indicator_report(bars: DataFrame) -> DataFrame:
    """Per symbol at its last bar: all indicators, OK only if each of them is."""
    last = bars.groupBy("symbol").agg(F.max("date").alias("date"))
    bands = bollinger(bars).join(last, ["symbol", "date"]).select("symbol", F.col("status").alias("bollinger_status"), "mid", "percent_b")
    volume = volume_trend(bars).join(last, ["symbol", "date"]).select("symbol", "direction")
    joined = macd(bars).join(bands, "symbol").join(volume, "symbol")
    ok = (F.col("status") == "OK") & (F.col("bollinger_status") == "OK") & (F.col("direction") != "none")
    return joined.select("symbol", "macd", "signal", "mid", "percent_b", "direction", F.when(ok, "OK").otherwise("FAIL_CLOSED").alias("status"))

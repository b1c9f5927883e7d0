"""Queries p1 to p5: the data-quality operators over their whole tables, and their SQL where it can be told in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from outcomelens.functions.identifiers import identifier, identifier_sql
from outcomelens.operators import delivery, references, rolling, spikes, timestamps
from outcomelens.operators.runs import islands
from outcomelens.session import cut
from outcomelens.sources.tables import table

# ---- p1: references to records that do not exist


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """References and existence deltas of both kinds of target in one; the first letter of a key is its target's (s, r)."""
    audit, accuracy, signals = (table(spark, d, name) for name in ("decision_audit_trail", "recommendation_accuracy", "signals"))
    of = lambda kind, rows: rows.withColumn("key", F.concat(F.lit(kind), "key"))
    refs = of("s", references.references(audit, "decision_audit_trail", "signal_id").unionByName(references.references(accuracy, "recommendation_accuracy", "signal_id")))
    refs = refs.unionByName(of("r", references.references(accuracy, "recommendation_accuracy", "recommendation_id")))
    deltas = of("s", references.intervals_to_deltas(signals, identifier(F.col("signal_id")), F.col("loaded_at"), F.col("deleted_at")))
    return refs, deltas.unionByName(of("r", references.first_seen_deltas(audit, identifier(F.col("recommendation_id")), F.col("received_at"))))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphans(*_sides(spark, d))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return references.report(*_sides(spark, d))


def p1_current(spark: SparkSession, d: str) -> DataFrame:
    found = references.current_orphans(references.counts(*_sides(spark, d)))
    target = F.when(F.startswith("key", F.lit("s")), "signals").otherwise("recommendations")
    return found.select(target.alias("target"), F.substring("key", 2, 1_000_000).alias("key"), "refs")


_SIG, _REC = identifier_sql("signal_id"), identifier_sql("recommendation_id")
_REFS_SQL = f"""
sig as (select {_SIG} k, loaded_at a, deleted_at b from signals where loaded_at is not null and (deleted_at is null or deleted_at > loaded_at)),
rec as (select {_REC} k, min(received_at) a from decision_audit_trail where received_at is not null group by 1),
ref as (
  select 'decision_audit_trail' tab, 'signal_id' field, row_id, received_at w, {_SIG} k from decision_audit_trail
  union all select 'recommendation_accuracy', 'signal_id', row_id, received_at, {_SIG} from recommendation_accuracy
  union all select 'recommendation_accuracy', 'recommendation_id', row_id, received_at, {_REC} from recommendation_accuracy),
judged as (
  select tab, field, strftime(w, '%Y-%m') period, row_id, k, w,
    case when field = 'signal_id' then exists (select 1 from sig where sig.k = ref.k and sig.a <= ref.w and (sig.b is null or sig.b > ref.w))
         else exists (select 1 from rec where rec.k = ref.k and rec.a <= ref.w) end as alive
  from ref where k is not null and w is not null)"""

# ---- p2: rolling totals


def _events_once(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    return delivery.first_deliveries(table(spark, d, "events_synthetic"), "event_id", columns)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    once = _events_once(spark, d, ["strategy_id", "timestamp", "realized_pnl"])
    parts = rolling.segments(rolling.daily(once, "strategy_id", "timestamp", "realized_pnl"))
    found = rolling.by_day(parts.where("total_7 < 0 and total_30 > 0"))
    return found.select(F.col("entity").alias("strategy_id"), F.date_format("day", "yyyy-MM-dd").alias("day"))


def p2_rolling(spark: SparkSession, d: str) -> DataFrame:
    once = _events_once(spark, d, ["strategy_id", "timestamp", "realized_pnl"])
    return rolling.rolling_totals(once, "strategy_id", "timestamp", "realized_pnl").withColumnRenamed("entity", "strategy_id")


_EVENT = identifier_sql("event_id")
_DAYS_SQL = f"""
once as (select strategy_id, "timestamp" t, realized_pnl v from (
  select *, row_number() over (partition by coalesce({_EVENT}, 'row:' || row_id) order by row_id) rn from events_synthetic) where rn = 1),
daily as (select strategy_id, cast(t as date) as dy,
  sum(case when isfinite(v) then cast(round(v * 100) as decimal(38,0)) else 0 end) c
  from once where strategy_id is not null and t is not null group by 1, 2),
cal as (select strategy_id, cast(unnest(generate_series(min(dy), max(dy), interval 1 day)) as date) as dy from daily group by 1),
roll as (select cal.strategy_id, cal.dy,
  sum(coalesce(c, 0)) over (partition by cal.strategy_id order by cal.dy rows between 6 preceding and current row) t7,
  sum(coalesce(c, 0)) over (partition by cal.strategy_id order by cal.dy rows between 29 preceding and current row) t30
  from cal left join daily on daily.strategy_id = cal.strategy_id and daily.dy = cal.dy)"""

# ---- p3: messages delivered more than once


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    events = delivery.surplus_rows(table(spark, d, "events_synthetic"), "event_id")
    audit = delivery.surplus_rows(table(spark, d, "decision_audit_trail"), "signal_id")
    return events.select(F.lit("events_synthetic").alias("tab"), "row_id").unionByName(audit.select(F.lit("decision_audit_trail").alias("tab"), "row_id"))


def p3_ranges(spark: SparkSession, d: str) -> DataFrame:
    ids = delivery.parsed(table(spark, d, "decision_audit_trail"), "signal_id")
    return delivery.ranges(ids.where("producer is not null"))


def _surplus_sql(tab: str, column: str) -> str:
    key = identifier_sql(column)
    return f"select '{tab}' tab, row_id from (select row_id, {key} k, min(row_id) over (partition by {key}) f from {tab}) where k is not null and row_id <> f"


# ---- p4: timestamps in many notations and zones


def _texts(spark: SparkSession, d: str) -> DataFrame:
    exports, audit = table(spark, d, "regime_export"), table(spark, d, "decision_audit_trail")
    parts = [timestamps.texts(exports, "regime_export", "generated_at"), timestamps.texts(exports, "regime_export", "produced_at")]
    return parts[0].unionByName(parts[1]).unionByName(timestamps.texts(audit, "decision_audit_trail", "timestamp"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    read = timestamps.normalised(_texts(spark, d), table(spark, d, "producers"))
    return read.where(F.col("certain") & ~F.col("text").rlike(timestamps.CANONICAL)).select("tab", "row_id", "field", "utc_us")


def p4_normalised(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalised(_texts(spark, d), table(spark, d, "producers")).select("tab", "row_id", "field", "utc_us", "notation", "certain")


# ---- p5: implausible spikes

# Amounts are mixtures of gains and losses, whose tail begins further out than that of bars. Bars are some 200 readings a
# series, too few for such a quantile.
RULES = {"close": spikes.SpikeRules(), "volume": spikes.SpikeRules(), "realized_pnl": spikes.SpikeRules(threshold=0.98)}


def _bars(bars: DataFrame, field: str) -> DataFrame:
    """In order of date; a symbol has one row a day, so a century is a small block."""
    value, block = F.col(field).cast("double").alias("value"), F.floor(F.year("date") / 100).alias("block")
    return bars.select(F.lit(field).alias("field"), F.col("symbol").alias("series"), block, F.col("date").cast("timestamp").alias("at"), "row_id", value).where("value is not null")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Bars are judged on a log scale around a running median, amounts as they stand around the median of their month.
    Each event is judged once; then every row of a flagged event is flagged."""
    bars, events = table(spark, d, "outcomes_clusters"), table(spark, d, "events_synthetic")
    value, field = F.col("value"), F.col("field")
    once = delivery.first_deliveries(events, "event_id", ["strategy_id", "timestamp", "realized_pnl"]).where("realized_pnl is not null")
    at, pnl = F.col("timestamp").cast("timestamp"), F.lit("realized_pnl").alias("field")
    amounts = cut(once.select(pnl, F.col("strategy_id").alias("series"), F.unix_seconds(F.date_trunc("hour", at)).alias("block"), at.alias("at"), "row_id", F.col("realized_pnl").alias("value"), "key", "copies"))
    readings = _bars(bars, "close").unionByName(_bars(bars, "volume"))
    bad = spikes.impossible(value) | ((field == "close") & (value <= 0)) | ((field == "volume") & (value < 0)) | ((field == "realized_pnl") & spikes.filler(value))
    good = ~bad & F.col("series").isNotNull()
    # the runs and the running median of a bar share one sort; equal logs are equal values
    logs = readings.where(good & F.col("at").isNotNull()).withColumn("value", F.when(field == "close", F.log("value")).otherwise(F.log1p("value")))
    judged = islands(logs).withColumn("residual", value - spikes.running_level())
    paid = amounts.where(good).drop("key", "copies")
    judged = cut(judged.unionByName(islands(spikes.monthly_residuals(paid))))
    impossible = readings.where(bad).select("field", "row_id").unionByName(amounts.where(bad).select("field", "row_id"))
    flags = impossible.unionByName(spikes.spikes(judged, RULES)).unionByName(spikes.stuck_rows(judged.where("at is not null"), RULES))
    flags = cut(flags.distinct())
    flagged = cut(amounts.select("key", "copies", "row_id").join(flags.where("field = 'realized_pnl'").select("row_id"), "row_id"))
    again = delivery.keyed(events, "event_id").join(flagged.where("copies > 1").select("key"), "key").select("row_id")
    of_events = flagged.where("copies = 1").select("row_id").unionByName(again).select(F.lit("events_synthetic").alias("tab"), "row_id", pnl)
    return flags.where("field <> 'realized_pnl'").select(F.lit("outcomes_clusters").alias("tab"), "row_id", "field").unionByName(of_events)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_report, p1_current, p2_found, p2_rolling, p3_found, p3_ranges, p4_found, p4_normalised, p5_found)
}

SQL: dict[str, str] = {
    "p1_found": f"with {_REFS_SQL} select tab, field, period, row_id from judged where not alive",
    "p1_report": f"""with {_REFS_SQL} select tab, field, period, count(*) reference_count, count(*) filter (where not alive) orphan_count,
        round(count(*) filter (where not alive) / count(*), 6) orphan_share from judged group by 1, 2, 3""",
    "p1_current": f"""with {_REFS_SQL},
        live as (select k, count(*) filter (where b is null) n from sig group by 1),
        r as (select case when field = 'signal_id' then 'signals' else 'recommendations' end target, k, count(*) refs from judged group by 1, 2)
        select target, r.k as key, refs from r left join live on live.k = r.k where target = 'signals' and coalesce(n, 0) = 0
        union all select target, r.k, refs from r where target = 'recommendations' and not exists (select 1 from rec where rec.k = r.k)""",
    "p2_found": f"with {_DAYS_SQL} select strategy_id, strftime(dy, '%Y-%m-%d') as \"day\" from roll where t7 < 0 and t30 > 0",
    "p2_rolling": f"""with {_DAYS_SQL} select strategy_id, dy as \"day\", cast(t7 as double) / 100 total_7, cast(t30 as double) / 100 total_30,
        round(cast(t7 as double) / 700, 6) average_7, round(cast(t30 as double) / 3000, 6) average_30 from roll""",
    "p3_ranges": f"""with ids as (select distinct k from (select {identifier_sql('signal_id')} k from decision_audit_trail) where regexp_matches(k, '{delivery.SEQUENCE}')),
        n as (select regexp_extract(k, '^[a-z]+') || '/' || array_to_string(list_transform(string_split(regexp_replace(k, '^[a-z]+-', ''), '-'), lambda x: cast(length(x) as varchar)), '.') producer,
          cast(regexp_replace(k, '[^0-9]', '', 'g') as bigint) v from ids where length(regexp_replace(k, '[^0-9]', '', 'g')) <= 18)
        select producer, min(v) low, max(v) high from (select producer, v, v - row_number() over (partition by producer order by v) g from n) group by producer, g""",
    "p3_found": f"{_surplus_sql('events_synthetic', 'event_id')} union all {_surplus_sql('decision_audit_trail', 'signal_id')}",
}

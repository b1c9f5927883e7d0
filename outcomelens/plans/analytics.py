"""The analytics queries over the domain tables, each with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from outcomelens.functions.exprs import r6, ratio, safe_double, setup_label, setup_recognised
from outcomelens.functions.identifiers import identifier, identifier_sql
from outcomelens.gates import floor, trend
from outcomelens.operators import backtest, bars, correlation, merging, outcomes, performance, sequences
from outcomelens.operators import events as tactical
from outcomelens.schema import AUDIT_REGIMES, EXPORT_REGIMES, FLOOR_REGIMES, REGIMES, SETUPS
from outcomelens.session import cut
from outcomelens.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _words(values) -> str:
    return ", ".join(repr(v) for v in values)


# ---- the event table

_ID = identifier_sql("event_id")
RAW = f"""raw as (select row_id seq, event_id, source_bot, event_type, strategy_id, "timestamp" ts, regime, score,
  case when isfinite(realized_pnl) then realized_pnl end pnl, outcome, upper(trim(metadata->>'$.symbol')) symbol,
  coalesce(cast(metadata->'$.data_is_real' as varchar) = 'true', false) data_is_real,
  case when coalesce(source_bot, '') = '' then 'source_bot_missing' when coalesce(event_type, '') = '' then 'event_type_missing'
    when coalesce(strategy_id, '') = '' then 'strategy_id_missing' when "timestamp" is null then 'timestamp_missing'
    when score is not null and not (score >= 0 and score <= 1) then 'score_out_of_range' end invalid
  from (select *, row_number() over (partition by coalesce({_ID}, 'row:' || row_id) order by row_id) rn from events_synthetic) where rn = 1)"""
TE = f"{RAW}, te as (select *, event_type = 'TRADE_OUTCOME' trade from raw where invalid is null)"
_PNL = "cast(coalesce(sum(case when trade then cast(pnl as decimal(28,2)) end), 0) as double)"
_REG = "case when coalesce(regime, '') = '' then 'UNKNOWN' else regime end"


def _mean(x: str) -> str:
    return f"round(cast(sum(cast({x} as decimal(28,9))) as double) / nullif(count({x}), 0), 6)"


#: What operators that read the events several times need of them; these events are written once.
_CORE = ("seq", "ts", "event_type", "strategy_id", "regime", "score", "expected_rr", "pnl", "outcome", "data_is_real")


def _event_query(operator: Callable[[DataFrame], DataFrame], passes: int = 1) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        events = tactical.tactical_events(table(spark, d, "events_synthetic"))
        return operator(cut(events.select(*_CORE)) if passes > 1 else events)

    return query


def _events(name: str, operator: Callable[[DataFrame], DataFrame], select: str, passes: int = 1) -> None:
    _add(name, _event_query(operator, passes), f"with {TE} {select}")


_add(
    "event_validation",
    lambda spark, d: tactical.validation(table(spark, d, "events_synthetic")),
    f"with {RAW} select coalesce(invalid, 'valid') status, count(*) events from raw group by 1",
)
_events(
    "data_quality",
    performance.data_quality,
    """select count(*) total_events, count(*) filter (where regime is null) missing_regime, count(*) filter (where score is null) missing_score,
       count(*) filter (where pnl is null) missing_pnl, count(*) filter (where outcome is null) missing_outcome from te""",
)
_events("source_counts", lambda e: performance.counts_by(e, "source_bot"), "select source_bot, count(*) events from te group by 1")
_events("event_type_counts", lambda e: performance.counts_by(e, "event_type"), "select event_type, count(*) events from te group by 1")
_STATS = f"""select strategy_id, count(*) total_events, count(*) filter (where trade) trade_outcomes, count(*) filter (where trade and outcome = 'WIN') wins,
  count(*) filter (where trade and outcome = 'LOSS') losses, count(*) filter (where trade and outcome = 'BREAKEVEN') breakevens, {_PNL} total_pnl,
  {_mean("score")} avg_score, min(seq) first_seq from te group by 1"""
_events(
    "strategy_stats",
    performance.strategy_stats,
    f"""select *, cast(null as double) avg_expected_rr, round(wins / nullif(trade_outcomes, 0), 6) win_rate, round(total_pnl / nullif(trade_outcomes, 0), 6) avg_realized_pnl
        from ({_STATS})""",
)
_events(
    "regime_stats",
    performance.regime_stats,
    f"""select *, round(wins / nullif(trade_outcomes, 0), 6) win_rate, round(total_pnl / nullif(trade_outcomes, 0), 6) avg_pnl from (
        select {_REG} regime, count(*) total_events, count(*) filter (where trade) trade_outcomes, count(*) filter (where trade and outcome = 'WIN') wins,
        count(*) filter (where trade and outcome = 'LOSS') losses, {_PNL} total_pnl, min(seq) first_seq from te group by 1)""",
)
_events("strategy_regime_counts", performance.strategy_regime_counts, "select strategy_id, regime, count(*) events from te where regime <> '' group by 1, 2")
_events("regime_strategy_counts", performance.regime_strategy_counts, f"select {_REG} regime, strategy_id, count(*) events from te group by 1, 2")
_events(
    "rejection_stats",
    performance.rejection_stats,
    """select *, round(rejections / nullif(rejections + trade_outcomes, 0), 6) rejection_rate from (
       select count(*) filter (where event_type = 'REJECTION') rejections, count(*) filter (where trade) trade_outcomes from te)""",
)
_events("rejections_by_strategy", lambda e: performance.rejections_by(e, "strategy_id"), "select strategy_id, count(*) rejections from te where event_type = 'REJECTION' group by 1")
_events("rejections_by_regime", lambda e: performance.rejections_by(e, "regime"), f"select {_REG} regime, count(*) rejections from te where event_type = 'REJECTION' group by 1")
_QUALITY = f"""select count(*) filter (where event_type = 'RECOMMENDATION') recommendations, count(*) filter (where s) scored_outcomes, {_mean("case when s then score end")} avg_score,
  count(*) filter (where s and score >= 0.7) high_count, count(*) filter (where s and score >= 0.7 and outcome = 'WIN') high_wins,
  count(*) filter (where s and score < 0.5) low_count, count(*) filter (where s and score < 0.5 and outcome = 'WIN') low_wins
  from (select *, trade and score is not null s from te)"""
_events(
    "recommendation_quality",
    performance.recommendation_quality,
    f"select *, round(high_wins / nullif(high_count, 0), 6) high_score_win_rate, round(low_wins / nullif(low_count, 0), 6) low_score_win_rate from ({_QUALITY})",
)
_events("score_vs_outcome", performance.score_vs_outcome, "select seq, strategy_id, score, outcome, pnl from te where trade and score is not null")
_SYMBOLS = f"""select symbol, count(*) events, count(*) filter (where trade) trade_outcomes, count(*) filter (where event_type = 'REJECTION') rejections,
  case when count(pnl) filter (where trade) > 0 then {_PNL} end total_pnl, min(seq) first_seq from te where symbol <> '' group by 1"""
_events("symbol_concentration", performance.symbol_concentration, _SYMBOLS)
_events("top_symbols", performance.top_symbols, f"{_SYMBOLS} order by events desc, first_seq limit 15")
_BUCKET = "case " + " ".join(f"when score >= {low} and score < {high} then '{name}'" for name, low, high in performance.CONFIDENCE) + " end"
_events(
    "confidence_distribution",
    performance.confidence_distribution,
    f"""select b.bucket, coalesce(events, 0) events, coalesce(wins, 0) wins, coalesce(losses, 0) losses, round(wins / nullif(wins + losses, 0), 6) win_rate
        from (select unnest([{_words(n for n, _, _ in performance.CONFIDENCE)}]) bucket) b left join (
        select {_BUCKET} bucket, count(*) events, count(*) filter (where trade and outcome = 'WIN') wins, count(*) filter (where trade and outcome = 'LOSS') losses
        from te where score is not null group by 1) f on f.bucket = b.bucket""",
)
_events(
    "candidate_ranking",
    performance.candidate_ranking,
    f"""select *, round(coalesce(avg_score, 0.5) * coalesce(win_rate, 0.5), 9) composite from (select *, round(wins / nullif(trade_outcomes, 0), 6) win_rate from (
        select symbol, strategy_id, count(*) events, count(*) filter (where trade) trade_outcomes, count(*) filter (where trade and outcome = 'WIN') wins,
        round({_PNL} / nullif(count(pnl) filter (where trade), 0), 6) avg_pnl, {_mean("score")} avg_score, min(seq) first_seq from te where symbol <> '' group by 1, 2))""",
)
_events(
    "strategy_top_regime",
    performance.strategy_top_regime,
    """select strategy_id, regime top_regime, events from (select *, row_number() over (partition by strategy_id order by events desc, f) k from (
       select strategy_id, regime, count(*) events, min(seq) f from te where regime <> '' group by 1, 2)) where k = 1""",
)
_events(
    "regime_top_strategy",
    performance.regime_top_strategy,
    f"""select regime, strategy_id top_strategy_id, events from (select *, row_number() over (partition by regime order by events desc, f) k from (
        select {_REG} regime, strategy_id, count(*) events, min(seq) f from te group by 1, 2)) where k = 1""",
)
_SUMMARY = f"""select count(*) total_events, count(distinct strategy_id) strategies, count(distinct {_REG}) regimes, count(*) filter (where trade) trades,
  count(*) filter (where trade and outcome = 'WIN') wins, {_PNL} total_pnl from te"""
_events(
    "executive_summary",
    performance.executive_summary,
    f"select *, round(wins / nullif(trades, 0), 6) win_rate, case when trades < 30 then 'DIAGNOSTIC_ONLY' else 'OK' end confidence from ({_SUMMARY})",
)
_events(
    "baseline_snapshot",
    performance.baseline_snapshot,
    f"""select metric, subject, cast(value as double) "value" from (
        select 'total_events' metric, '' subject, total_events "value" from ({_SUMMARY})
        union all select 'overall_win_rate', '', round(wins / nullif(trades, 0), 6) from ({_SUMMARY})
        union all select 'avg_pnl', '', round(total_pnl / nullif(trades, 0), 6) from ({_SUMMARY})
        union all select 'strategy_win_rate', strategy_id, round(count(*) filter (where trade and outcome = 'WIN') / nullif(count(*) filter (where trade), 0), 6) from te group by strategy_id
        union all select 'regime_win_rate', {_REG}, round(count(*) filter (where trade and outcome = 'WIN') / nullif(count(*) filter (where trade), 0), 6) from te group by {_REG}
        union all select 'regime_events', {_REG}, count(*) from te group by {_REG})""",
    passes=3,
)
_events(
    "result_snapshot",
    performance.result_snapshot,
    f"""select (select count(*) from te) event_count, (select count(distinct strategy_id) from te) strategies, (select count(distinct {_REG}) from te) regimes,
        (select strategy_id from (select strategy_id, round(wins / nullif(trade_outcomes, 0), 6) w, first_seq from ({_STATS}) where trade_outcomes > 0) order by w desc, first_seq limit 1) top_strategy,
        (select regime from (select {_REG} regime, count(*) filter (where trade) n, min(seq) f from te group by 1) order by n desc, f limit 1) top_regime_fit,
        (select avg_score from ({_QUALITY})) recommendation_quality_score, case when (select count(*) from te) = 0 then 'EMPTY' else 'OK' end status""",
    passes=4,
)

# ---- sequences

_SETTLED = "select *, row_number() over (partition by strategy_id order by ts desc, seq desc) k from te where trade and outcome in ('WIN', 'LOSS', 'BREAKEVEN')"
_ROLLING = f"select strategy_id, count(*) trades, count(*) filter (where outcome = 'WIN') wins from ({_SETTLED}) where k <= 10 group by 1"
_events(
    "rolling_win_rates",
    sequences.rolling_win_rates,
    """select w.w as "window", count(*) trades, count(*) filter (where outcome = 'WIN') wins, round(count(*) filter (where outcome = 'WIN') / count(*), 6) win_rate
       from (select outcome, row_number() over (order by ts desc, seq desc) k from te where trade and outcome in ('WIN', 'LOSS', 'BREAKEVEN')) t
       join (select unnest([10, 30, 100]) w) w on t.k <= w.w group by 1""",
)
_events("rolling_by_strategy", sequences.rolling_by_strategy, f"select *, round(wins / trades, 6) win_rate from ({_ROLLING})")
_STREAKS = """select strategy_id, max(case when last then signed end) current_streak, coalesce(max(n) filter (where outcome = 'WIN'), 0) max_win_streak,
  coalesce(max(n) filter (where outcome = 'LOSS'), 0) max_loss_streak from (
    select *, case when outcome = 'WIN' then n else -n end signed, row_number() over (partition by strategy_id order by z desc) = 1 "last" from (
      select strategy_id, outcome, a - b g, count(*) n, max(a) z from (
        select strategy_id, outcome, row_number() over (partition by strategy_id order by ts, seq) a, row_number() over (partition by strategy_id, outcome order by ts, seq) b
        from te where trade and outcome in ('WIN', 'LOSS')) group by 1, 2, 3)) group by 1"""
_STREAKS = f"select *, case when current_streak < 0 then -current_streak else 0 end current_loss_streak, current_streak <= -3 flagged from ({_STREAKS})"
_events("streak_analysis", sequences.streak_analysis, _STREAKS)
_EROSION = f"""select b.strategy_id, round(b.w, 6) baseline_win_rate, round(r.w, 6) rolling_win_rate, round(b.w - r.w, 6) "drop", b.w - r.w >= 0.10 warning
  from (select strategy_id, count(*) filter (where outcome = 'WIN') / count(*) w from te where trade group by 1) b
  join (select strategy_id, wins / trades w from ({_ROLLING}) where trades >= 3) r on r.strategy_id = b.strategy_id"""
_events("edge_erosion", sequences.edge_erosion, _EROSION)
_BIAS = f"""select regime, events, trades, round(b, 6) base_rate, round(t, 6) trade_rate, round(t / b, 6) multiplier, t / b > 2.0 flagged from (
  select *, events / sum(events) over () b, trades / nullif(sum(trades) over (), 0) t from (select {_REG} regime, count(*) events, count(*) filter (where trade) trades from te group by 1))
  where t is not null"""
_events("regime_bias", sequences.regime_bias, _BIAS)
_BINS = """select bin, round(lo, 3) score_min, round(hi, 3) score_max, count(score) outcomes, count(*) filter (where outcome = 'WIN') wins,
  round(count(*) filter (where outcome = 'WIN') / nullif(count(score), 0), 6) win_rate from (
    select bin, a + (bin - 1) * step lo, case when bin < 10 then a + bin * step else z + cast(1e-9 as double) end hi from (
      select a, z, case when z > a then (z - a) / 10 else 0.1 end step from (select min(score) a, max(score) z from te where trade and outcome in ('WIN', 'LOSS')) where a is not null),
    (select cast(unnest(range(1, 11)) as integer) bin)) b
  left join (select score, outcome from te where trade and outcome in ('WIN', 'LOSS') and score is not null) s on s.score >= b.lo and s.score < b.hi group by 1, lo, hi"""
_events("score_calibration", sequences.score_calibration, _BINS)
_CALIBRATION = f"""select valid_bins, case when valid_bins >= 3 then round(rises / (valid_bins - 1), 3) end coefficient, coalesce(first > fifth, false) flagged from (
  select count(*) valid_bins, count(*) filter (where nxt > win_rate) rises from (select *, lead(win_rate) over (order by bin) nxt from bins where outcomes >= 5)),
  (select max(win_rate) filter (where bin = 1) first, max(win_rate) filter (where bin = 5) fifth from bins)"""
_add("score_calibration_summary", _event_query(sequences.score_calibration_summary, 2), f"with {TE}, bins as ({_BINS}) {_CALIBRATION}")
_add(
    "observations",
    _event_query(sequences.observations, 9),
    f"""with {TE}, bins as ({_BINS}), stats as (select *, round(wins / nullif(trade_outcomes, 0), 6) w from ({_STATS}) where trade_outcomes >= 5),
    rq as (select round(high_wins / nullif(high_count, 0), 6) h, round(low_wins / nullif(low_count, 0), 6) l from ({_QUALITY})),
    rej as (select round(count(*) filter (where event_type = 'REJECTION') / nullif(count(*) filter (where event_type = 'REJECTION' or trade), 0), 6) r from te)
    select cast(ordinal as integer) ordinal, rule, subject, round(cast(v as double), 6) "value" from (
      select 1 ordinal, 'missing_outcome' rule, '' subject, count(*) filter (where outcome is null) / count(*) v from te having count(*) filter (where outcome is null) / count(*) > 0.3
      union all select 2, 'weak_strategy', strategy_id, w from stats where w < 0.35 union all select 2, 'strong_strategy', strategy_id, w from stats where w > 0.70
      union all select 3, 'score_inversion', '', h from rq where h < l
      union all select 4, 'calibration', '', coefficient from ({_CALIBRATION}) where flagged
      union all select 5, 'regime_bias', regime, multiplier from ({_BIAS}) where flagged
      union all select 6, 'edge_erosion', strategy_id, "drop" from ({_EROSION}) where warning
      union all select 7, 'loss_streak', strategy_id, current_loss_streak from ({_STREAKS}) where flagged
      union all select 8, 'rejection_rate', '', r from rej where r > 0.5)""",
)
_events(
    "strategy_dashboard",
    sequences.strategy_dashboard,
    f"""select s.strategy_id, trade_outcomes, wins, losses, round(wins / nullif(trade_outcomes, 0), 6) win_rate, total_pnl, coalesce(k.flagged, false) loss_streak, coalesce(e.warning, false) edge_erosion
        from ({_STATS}) s left join ({_STREAKS}) k on k.strategy_id = s.strategy_id left join ({_EROSION}) e on e.strategy_id = s.strategy_id""",
    passes=3,
)

# ---- distributions and fit

_VALUES = "from te where trade and pnl is not null"
_SIGNS = "count(*) n, count(*) filter (where pnl > 0) wins, count(*) filter (where pnl < 0) losses, count(*) filter (where pnl = 0) breakevens"
_events(
    "pnl_distribution",
    outcomes.pnl_distribution,
    f"""select {_SIGNS}, {_PNL} total, round({_PNL} / nullif(count(*), 0), 6) mean, round(median(pnl), 6) median, min(pnl) lowest, max(pnl) highest,
        case when count(*) >= 2 then round(stddev_pop(pnl), 2) end deviation {_VALUES}""",
)
_events("pnl_by_strategy", outcomes.pnl_by_strategy, f"select strategy_id, {_SIGNS}, {_PNL} total, round({_PNL} / nullif(count(*), 0), 6) mean {_VALUES} group by 1")
_events(
    "pnl_histogram",
    outcomes.pnl_histogram,
    f"""select bin, round(lo, 6) low, round(hi, 6) high, count(pnl) n from (
        select bin, n, a + (bin - 1) * w lo, case when bin = n then z else a + bin * w end hi from (
          select a, z, (z - a) / 6 w, case when z > a then 6 else 1 end n from (select min(pnl) a, max(pnl) z {_VALUES}) where a is not null), (select cast(unnest(range(1, 7)) as integer) bin) where bin <= n) b
        left join (select pnl {_VALUES}) v on v.pnl >= b.lo and (v.pnl < b.hi or (b.bin = b.n and v.pnl <= b.hi)) group by 1, 2, 3""",
)
_FITREG = f"case when upper(trim(regime)) in ({_words(REGIMES)}) then upper(trim(regime)) else 'UNKNOWN' end"
_FIT = f"""select *, case when decisive >= 30 then round(wins / decisive, 4) end win_rate, case when decisive >= 30 then 'DIAGNOSTIC_ONLY' else 'INSUFFICIENT_SAMPLE' end status from (
  select *, wins + losses decisive from (select {_FITREG} regime, strategy_id, count(*) total, count(*) filter (where outcome = 'WIN') wins, count(*) filter (where outcome = 'LOSS') losses
  from te where trade group by 1, 2))"""
_events("regime_strategy_fit", outcomes.regime_strategy_fit, _FIT)
_events(
    "regime_strategy_grid",
    outcomes.regime_strategy_grid,
    f"""select r.regime, s.strategy_id, case when f.total is null then '-' when f.win_rate is null then 'withheld' else 'shown' end cell, coalesce(decisive, 0) decisive, win_rate
        from (select unnest([{_words(REGIMES)}]) regime) r cross join (select distinct strategy_id from te where trade) s left join ({_FIT}) f on f.regime = r.regime and f.strategy_id = s.strategy_id""",
)
_events(
    "outcomes_from_events",
    outcomes.outcomes_from_events,
    "select seq, cast(ts as date) as \"date\", strategy_id setup_label, coalesce(outcome, '') outcome, cast(null as double) return_pct, data_is_real from te where trade",
)

# ---- outcomes per setup, from the labelled bars


def _records(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "outcomes_clusters")
    outcome = F.when(F.col("win"), "WIN").when(~F.col("win"), "LOSS").otherwise("")
    change = r6((F.col("close") - F.col("open")) / F.nullif(F.col("open"), F.lit(0.0)) * 100)
    kept = rows.where("setup_label is not null")
    change = F.when(~F.isnan("close") & (F.abs("close") < F.lit(float("inf"))), change)
    return kept.select(F.col("row_id").alias("seq"), "date", "setup_label", outcome.alias("outcome"), change.alias("return_pct"), F.coalesce("data_is_real", F.lit(False)).alias("data_is_real"), "win")


_W = "' ' || chr(9) || chr(10) || chr(13)"
_LABEL = f"upper(trim(setup_label, {_W}))"
_SETUP = f"case when {_LABEL} in ({_words(SETUPS)}) then {_LABEL} else 'UNKNOWN' end"
_RECORDS = f"""rec as (select row_id seq, "date" dt, setup_label, {_SETUP} setup, case when win then 'WIN' when not win then 'LOSS' else 'UNKNOWN' end result, win, coalesce(data_is_real, false) real,
  case when isfinite("close") then round(("close" - "open") / nullif("open", 0) * 100, 6) end pct from outcomes_clusters where setup_label is not null)"""


def _runs_sql(state: str, where: str, key: str = "setup") -> str:
    return f"""select {key}, {state} state, max(n) n from (select {key}, {state}, a - b g, count(*) n from (select {key}, {state}, row_number() over (partition by {key} order by dt, seq) a,
      row_number() over (partition by {key}, {state} order by dt, seq) b from {where}) group by 1, 2, 3) group by 1, 2"""


_add(
    "setup_outcome_summary",
    lambda spark, d: outcomes.setup_outcome_summary(_records(spark, d)),
    f"""with {_RECORDS}, runs as ({_runs_sql("result", "rec")})
    select s.setup, sample, real, greatest(0, 30 - real) needed, wins, losses, breakevens, sample - wins - losses - breakevens other,
      case when sample >= 30 then round(wins / nullif(wins + losses, 0), 4) end win_rate, case when sample >= 30 then mean_return end mean_return,
      coalesce((select n from runs where runs.setup = s.setup and state = 'WIN'), 0) longest_win, coalesce((select n from runs where runs.setup = s.setup and state = 'LOSS'), 0) longest_loss,
      all_real, case when real >= 30 then 'DIAGNOSTIC_ONLY' else 'INSUFFICIENT_SAMPLE' end status
    from (select setup, count(*) sample, count(*) filter (where real) real, count(*) filter (where result = 'WIN') wins, count(*) filter (where result = 'LOSS') losses,
      count(*) filter (where result = 'BREAKEVEN') breakevens, round(avg(pct), 4) mean_return, bool_and(real) all_real from rec group by 1) s""",
)
_CLUSTERS = f"{_RECORDS}, c as (select setup, seq, dt, win from rec where win is not null union all select '*', seq, dt, win from rec where win is not null), runs as ({_runs_sql('win', 'c')})"
_add(
    "win_loss_clusters",
    lambda spark, d: outcomes.win_loss_clusters(_records(spark, d)),
    f"""with {_CLUSTERS} select *, greatest(longest_win, longest_loss) >= 3 flagged from (select setup, count(*) n, count(*) filter (where win) wins, count(*) filter (where not win) losses,
      round(count(*) filter (where win) / count(*), 4) win_rate, coalesce((select n from runs where runs.setup = c.setup and state), 0) longest_win,
      coalesce((select n from runs where runs.setup = c.setup and not state), 0) longest_loss from c group by 1) where (select count(*) from c where setup = '*') >= 6""",
)
_add(
    "setup_label_normalize",
    lambda spark, d: table(spark, d, "outcomes_clusters").groupBy("setup_label").agg(F.count("*").alias("n")).select("setup_label", setup_label(F.col("setup_label")).alias("setup"), setup_recognised(F.col("setup_label")).alias("recognised"), "n"),
    f"select setup_label, {_SETUP} setup, coalesce({_LABEL}, '') in ({_words((*SETUPS, '', 'UNKNOWN'))}) recognised, count(*) n from outcomes_clusters group by setup_label",
)
_add(
    "unrecognized_labels",
    lambda spark, d: outcomes.unrecognised_labels(_records(spark, d)),
    f"with {_RECORDS} select setup_label, min(seq) first_seq, count(*) n from rec where {_LABEL} not in ({_words((*SETUPS, '', 'UNKNOWN'))}) group by 1",
)

# ---- correlation of two streams


def _streams(spark: SparkSession, d: str) -> DataFrame:
    events = tactical.tactical_events(table(spark, d, "events_synthetic"))
    stream = F.when(F.endswith("source_bot", F.lit("Options")), "options").when(F.endswith("source_bot", F.lit("V2")), "stock")
    return events.withColumn("stream", stream).where("stream is not null")


def _all_real(spark: SparkSession, d: str) -> DataFrame:
    """The streams with every amount counted as real."""
    return _streams(spark, d).withColumn("data_is_real", F.lit(True))


_ST = f"{TE}, st as (select *, case when source_bot like '%Options' then 'options' when source_bot like '%V2' then 'stock' end stream from te where source_bot like '%Options' or source_bot like '%V2')"
_add(
    "correlation_exclusions",
    lambda spark, d: correlation.correlation_exclusions(_streams(spark, d)),
    f"""with {_ST} select stream, case when not trade then 'not_trade_outcome' when coalesce(outcome, '') = 'PENDING' then 'outcome_pending' when pnl is null then 'realized_pnl_missing_or_invalid'
    when not data_is_real then 'data_not_real' else 'eligible' end reason, count(*) events from st group by 1, 2""",
)


def _daily_sql(real: str) -> str:
    return f"""daily as (select stream, cast(ts as date) dy, cast(sum(cast(pnl as decimal(28,2))) as double) pnl from st where trade and coalesce(outcome, '') <> 'PENDING' and pnl is not null{real} group by 1, 2),
  ov as (select a.dy, a.pnl a, b.pnl b from daily a join daily b on a.dy = b.dy where a.stream = 'stock' and b.stream = 'options')"""


# each with the gate that leaves out amounts that are not real, and over all amounts
for _suffix, _gate, _real in (("_real", True, " and data_is_real"), ("", False, "")):
    _DAILY = _daily_sql(_real)
    _add(f"daily_pnl{_suffix}", lambda spark, d, gate=_gate: correlation.daily_pnl(_streams(spark, d), gate), f'with {_ST}, {_DAILY} select stream, dy as "day", pnl from daily')
    _add(
        f"strategy_correlation{_suffix}",
        lambda spark, d, gate=_gate: correlation.strategy_correlation(_streams(spark, d), "stock", "options", real_only=gate),
        f"""with {_ST}, {_DAILY}, s as (select count(*) n, greatest(-1, least(1, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0))) r from ov)
        select n overlap_days, case when n >= 30 then round(r, 6) end correlation, case when n >= 30 and abs(r) < 1 then round(tanh(atanh(r) - 1.96 / sqrt(n - 3)), 6) end "low",
        case when n >= 30 and abs(r) < 1 then round(tanh(atanh(r) + 1.96 / sqrt(n - 3)), 6) end "high", case when n < 30 then 'insufficient_overlap' when n < 60 then 'small_sample' else 'ok' end status from s""",
    )
    _add(
        f"rolling_correlation{_suffix}",
        lambda spark, d, gate=_gate: correlation.rolling_correlation(_streams(spark, d), "stock", "options", real_only=gate),
        f"""with {_ST}, {_DAILY} select dy as "day", round(greatest(-1, least(1, c / nullif(da * db, 0))), 4) correlation from (select dy, row_number() over (order by dy) k, covar_pop(a, b) over w c, stddev_pop(a) over w da,
        stddev_pop(b) over w db from ov window w as (order by dy rows between 29 preceding and current row)) where k >= 30""",
    )

# ---- holding periods


def _holding(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("strategy_id"), F.col("o_orderdate").cast("string").alias("entry_time"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").cast("string").alias("exit_time")).join(orders, "o_orderkey")


_HOLD = """h as (select o_orderpriority strategy_id, case when l_shipdate > o_orderdate then date_diff('microsecond', o_orderdate, l_shipdate) / 86400000000 end d
  from lineitem join orders on l_orderkey = o_orderkey)"""
_SPAN = "count(d) n, round(avg(d), 6) mean_days, round(median(d), 6) median_days, round(min(d), 6) shortest, round(max(d), 6) longest"
_add(
    "holding_period_summary",
    lambda spark, d: outcomes.holding_period_summary(_holding(spark, d)),
    f"with {_HOLD} select {_SPAN}, cast(0 as bigint) skipped_missing, count(*) filter (where d is null) skipped_invalid from h",
)
_add("holding_period_by_strategy", lambda spark, d: outcomes.holding_period_by_strategy(_holding(spark, d)), f"with {_HOLD} select strategy_id, {_SPAN} from h where d is not null group by 1")

# ---- bars


def _valid(spark: SparkSession, d: str) -> DataFrame:
    return bars.valid_bars(table(spark, d, "outcomes_clusters")).select("symbol", "date", "open", "high", "low", "close", "volume")


_GOODP = "coalesce({0} > 0 and isfinite({0}), false)"
_ERRORS = [
    (f"not {_GOODP.format('"open"')}", "open_invalid"), (f"not {_GOODP.format('high')}", "high_invalid"), (f"not {_GOODP.format('low')}", "low_invalid"),
    (f"not {_GOODP.format('"close"')}", "close_invalid"), ("high < low", "high_below_low"), (f'{_GOODP.format(chr(34) + "open" + chr(34))} and not ("open" between low and high)', "open_outside_range"),
    (f'{_GOODP.format(chr(34) + "close" + chr(34))} and not ("close" between low and high)', "close_outside_range"), ("volume < 0", "volume_negative"), ('"date" is null', "date_missing"),
    ("before >= \"date\"", "date_not_increasing"),
]
_CHECKED = "ck as (select row_id, symbol, \"date\" dt, \"open\" o, high h, low l, \"close\" c, volume v, list_filter([" + ", ".join(f"case when {cond} then '{name}' end" for cond, name in _ERRORS) + """], lambda x: x is not null) errors
  from (select *, lag("date") over (partition by symbol order by "date", row_id) before from outcomes_clusters)), b as (select * from ck where len(errors) = 0)"""
_add(
    "bar_validation",
    lambda spark, d: bars.bar_validation(table(spark, d, "outcomes_clusters")),
    f"""with {_CHECKED} select symbol, e as "error", count(*) bars from (select symbol, unnest(errors) e from ck) group by 1, 2
    union all select symbol, '', count(*) from ck group by 1 having sum(len(errors)) = 0""",
)
_C01 = "greatest(0.0, least(1.0, {}))"
_N = "partition by symbol order by dt rows between"


def _pattern_sql(inner: str, ready: str, detected: str, confidence: str, reason: str = "null") -> str:
    return f"""select symbol, dt, ok detected, case when ok then round({_C01.format(confidence)}, 4) else 0.0 end confidence, case when not ready then 'insufficient_bars' else rs end reason from (
      select *, coalesce(ready and ({detected}) and rs is null, false) ok from (select *, {ready} ready, {reason} rs from ({inner})))"""


#: Per pattern: its rows, whether it has bars enough, its rule, its confidence and why else it fails closed.
_PATTERN_ARGS = {
    "breakout_after_consolidation": (
        f"select *, (hi - lo) / ((hi + lo) / 2) * 100 spread, (c / hi - 1) * 100 rise from (select *, max(h) over ({_N} 10 preceding and 1 preceding) hi, min(l) over ({_N} 10 preceding and 1 preceding) lo, count(c) over ({_N} 10 preceding and 1 preceding) k from b)",
        "k = 10", "spread <= 5 and c > hi", f"0.5 * {_C01.format('1 - spread / 5')} + 0.5 * {_C01.format('rise / 5')}",
    ),
    "volume_spike": (
        f"select *, v / base times from (select *, avg(v) over ({_N} 20 preceding and 1 preceding) base, count(v) over ({_N} 20 preceding and 1 preceding) kv, count(c) over ({_N} 20 preceding and 1 preceding) k from b)",
        "k = 20", "times >= 2", "times / 4", "case when v is null or kv < 20 then 'volume_missing' when base <= 0 then 'degenerate_baseline' end",
    ),
    "trend_continuation": (
        f"select *, sum(case when mv > 0 then 1 else 0 end) over ({_N} 9 preceding and current row) / 10 ups, sum(case when mv < 0 then 1 else 0 end) over ({_N} 9 preceding and current row) / 10 downs from (select *, c - lag(c) over (partition by symbol order by dt) mv, c - lag(c, 10) over (partition by symbol order by dt) net from b)",
        "net is not null", "case when net > 0 then mv > 0 and ups >= 0.6 when net < 0 then not (mv > 0) and downs >= 0.6 else false end", "case when net > 0 then ups else downs end",
    ),
    "mean_reversion_candidate": (
        f"select *, (c - m) / nullif(sd, 0) z from (select *, avg(c) over ({_N} 19 preceding and current row) m, stddev_pop(c) over ({_N} 19 preceding and current row) sd, count(c) over ({_N} 19 preceding and current row) k, min(c) over ({_N} 19 preceding and current row) = max(c) over ({_N} 19 preceding and current row) flat from b)",
        "k = 20", "abs(z) >= 2", "0.5 + 0.5 * (abs(z) - 2) / 2", "case when flat then 'zero_variance' end",
    ),
    "gap_continuation_risk": ("select *, (o / p - 1) * 100 g from (select *, lag(c) over (partition by symbol order by dt) p from b)", "p is not null", "abs(g) >= 2", "abs(g) / 4"),
    "failed_breakout": (
        f"select *, (base / c - 1) * 100 + (p / base - 1) * 100 sz from (select *, max(h) over ({_N} 11 preceding and 2 preceding) base, count(c) over ({_N} 11 preceding and 2 preceding) k, lag(h) over (partition by symbol order by dt) p from b)",
        "k = 10", "p > base and c < base", "sz / 10",
    ),
    "higher_high_higher_low": (
        f"select *, (abs(h2 / h1 - 1) * 100 + abs(l2 / l1 - 1) * 100) sz from (select *, max(h) over ({_N} 9 preceding and 5 preceding) h1, max(h) over ({_N} 4 preceding and current row) h2, min(l) over ({_N} 9 preceding and 5 preceding) l1, min(l) over ({_N} 4 preceding and current row) l2, count(c) over ({_N} 9 preceding and current row) k from b)",
        "k = 10", "(h2 > h1 and l2 > l1) or (h2 < h1 and l2 < l1)", "sz / 10",
    ),
    "drawdown_recovery": (
        f"""select w.*, coalesce((c - trough) / nullif(peak - trough, 0), 0) rec from (select symbol, dt, any_value(c) c, count(*) k, min(least(fall, 0)) fall, coalesce(arg_min(cc, (fall, ii)) filter (where fall < 0), 0) trough,
          coalesce(arg_min(top, (fall, ii)) filter (where fall < 0), 0) peak from (select x.symbol, x.dt, x.c, y.c cc, y.i ii, max(y.c) over (partition by x.symbol, x.dt order by y.i) top, (y.c / max(y.c) over (partition by x.symbol, x.dt order by y.i) - 1) * 100 fall
          from bn x join bn y on y.symbol = x.symbol and y.i between x.i - 19 and x.i) group by 1, 2) w""",
        "k = 20", "abs(fall) >= 10 and rec >= 0.5", f"0.5 * {_C01.format('rec')} + 0.5 * {_C01.format('abs(fall) / 20')}",
    ),
}
_PATTERN_SQL = {name: _pattern_sql(*args) for name, args in _PATTERN_ARGS.items()}
_BN = "bn as (select *, row_number() over (partition by symbol order by dt) i from b)"
_NAMES = {
    "pattern_breakout": "breakout_after_consolidation", "pattern_volume_spike": "volume_spike", "pattern_trend": "trend_continuation", "pattern_mean_reversion": "mean_reversion_candidate",
    "pattern_gap": "gap_continuation_risk", "pattern_failed_breakout": "failed_breakout", "hh_hl_structure": "higher_high_higher_low", "drawdown_recovery": "drawdown_recovery",
}
for _key, _name in _NAMES.items():
    _add(_key, lambda spark, d, name=_name: bars.pattern(_valid(spark, d), name), f'with {_CHECKED}, {_BN} select symbol, dt as "date", detected, confidence, reason from ({_PATTERN_SQL[_name]})')
_add(
    "pattern_scan",
    lambda spark, d: bars.pattern_scan(_valid(spark, d)),
    f"with {_CHECKED}, {_BN}, las as (select symbol, max(dt) dt from b group by 1) "
    + " union all ".join(f"select s.symbol, s.dt as \"date\", '{name}' pattern, detected, confidence, reason from ({sql}) s join las on las.symbol = s.symbol and las.dt = s.dt" for name, sql in _PATTERN_SQL.items()),
)
_WORD = lambda *cases: "case " + " ".join(f"when {cond} then '{word}'" for cond, word in cases[:-1]) + f" else '{cases[-1]}' end"
_UP, _DOWN = "g >= 2", "g <= -2"
_WITH = f"(case when {_UP} then c > o when {_DOWN} then c < o else false end)"
_FILLED = f"(case when {_UP} then l <= p when {_DOWN} then h >= p else false end)"
_MEASURES = {
    "breakout_after_consolidation": [
        ("consolidation_high", 6, "hi"), ("consolidation_low", 6, "lo"), ("consolidation_range_pct", 6, "spread"), ("consolidated", None, "spread <= 5"), ("breakout_level", 6, "hi"),
        ("breakout_close", 6, "c"), ("breakout_pct", 6, "rise"),
    ],
    "volume_spike": [("last_volume", 6, "v"), ("baseline_volume", 6, "base"), ("ratio", 6, "times")],
    "trend_continuation": [
        ("direction", None, _WORD(("net > 0", "up"), ("net < 0", "down"), "flat")), ("net_return_pct", 6, "(c / (c - net) - 1) * 100"), ("up_fraction", 4, "ups"), ("down_fraction", 4, "downs"),
        ("last_bar_move_up", None, "mv > 0"),
    ],
    "mean_reversion_candidate": [
        ("mean", 6, "m"), ("stdev", 6, "sd"), ("last_close", 6, "c"), ("zscore", 4, "z"), ("deviation_pct", 6, "(c / m - 1) * 100"),
        ("direction", None, _WORD(("z <= -2", "oversold_reversion_up"), ("z >= 2", "overbought_reversion_down"), "none")),
    ],
    "gap_continuation_risk": [
        ("gap_pct", 6, "g"), ("direction", None, _WORD((_UP, "gap_up"), (_DOWN, "gap_down"), "none")), ("closed_in_gap_direction", None, _WITH), ("gap_filled", None, _FILLED),
        ("continuation_risk", None, f"abs(g) >= 2 and {_WITH} and not {_FILLED}"), ("prev_close", 6, "p"), ("open", 6, "o"),
    ],
    "failed_breakout": [("base_high", 6, "base"), ("breakout_high", 6, "p"), ("fail_close", 6, "c"), ("poke_pct", 6, "(p / base - 1) * 100"), ("retrace_pct", 6, "(base / c - 1) * 100")],
    "higher_high_higher_low": [
        ("structure", None, _WORD(("h2 > h1 and l2 > l1", "HH_HL"), ("h2 < h1 and l2 < l1", "LH_LL"), "mixed")), ("first_half_high", 6, "h1"), ("second_half_high", 6, "h2"), ("first_half_low", 6, "l1"),
        ("second_half_low", 6, "l2"),
    ],
    "drawdown_recovery": [
        ("peak", 6, "case when fall < 0 then peak end"), ("trough", 6, "case when fall < 0 then trough end"), ("max_drawdown_pct", 6, "fall"), ("recovered_frac", 4, "rec"), ("current_close", 6, "c"),
    ],
}


def _evidence_sql(name: str) -> str:
    inner, ready, _, _, *reason = _PATTERN_ARGS[name]
    rows = f"select * from ({inner}) where coalesce({ready}, false) and ({reason[0] if reason else 'null'}) is null"
    parts = [
        f"select symbol, dt, '{name}' pattern, '{m}' measure, {f'round(cast({x} as double), {digits})' if digits else 'cast(null as double)'} number, {'cast(null as varchar)' if digits else f'cast({x} as varchar)'} word from ({rows})"
        for m, digits, x in _MEASURES[name]
    ]
    return " union all ".join(parts)


_LAST = "las as (select symbol, max(dt) dt from b group by 1)"
_add(
    "pattern_evidence",
    lambda spark, d: bars.pattern_evidence(_valid(spark, d)),
    f"with {_CHECKED}, {_BN}, {_LAST} " + " union all ".join(f'select s.symbol, s.dt as "date", pattern, measure, number, word from ({_evidence_sql(name)}) s join las on las.symbol = s.symbol and las.dt = s.dt' for name in _PATTERN_ARGS),
)
_NEEDS = {name: (more + (getattr(bars.RULES, rule) if rule else 0), volume) for name, (rule, more, volume) in bars.NEEDS.items()}
_add(
    "pattern_signals",
    lambda spark, d: bars.pattern_signals(bars.valid_bars(table(spark, d, "outcomes_clusters")).select("symbol", "date", "open", "high", "low", "close", "volume", "data_is_real")),
    f"""with {_CHECKED}, {_BN}, {_LAST}, sc as ({" union all ".join(f"select symbol, dt, '{name}' pattern, detected, confidence, reason, {n} min_bars, {str(vol).lower()} needs_volume from ({_PATTERN_SQL[name]})" for name, (n, vol) in _NEEDS.items())}),
    re as (select b.symbol, bool_and(coalesce(r.data_is_real, false)) real from b join outcomes_clusters r on r.symbol = b.symbol and r."date" = b.dt and r.row_id = b.row_id group by 1)
    select sc.symbol, sc.dt as "date", pattern, detected, confidence, reason, min_bars, needs_volume, case reason when 'insufficient_bars' then 'bars' when 'volume_missing' then 'volume' end missing_data,
      true research_only, real and reason is null data_is_real from sc join las on las.symbol = sc.symbol and las.dt = sc.dt join re on re.symbol = sc.symbol""",
)
_add(
    "gap_risk",
    lambda spark, d: _valid(spark, d).select("symbol", "date", bars.gap_risk().alias("continuation_risk")),
    f"""with {_CHECKED} select symbol, dt as "date", coalesce(((o / p - 1) * 100 >= 2 and c > o and l > p) or ((o / p - 1) * 100 <= -2 and c < o and h < p), false) continuation_risk
    from (select *, lag(c) over (partition by symbol order by dt) p from b)""",
)
_BOLL = f"""select symbol, dt, case when k = 20 and not flat then 'OK' else 'FAIL_CLOSED' end status, case when k = 20 then round(m, 6) end mid, case when k = 20 then round(m + 2 * sd, 6) end "upper",
  case when k = 20 then round(m - 2 * sd, 6) end "lower", case when k = 20 and not flat then round((c - (m - 2 * sd)) / (4 * sd), 4) end percent_b, case when k = 20 then round(4 * sd / nullif(m, 0), 6) end bandwidth
  from (select *, case when flat then 0 else s0 end sd from (select *, avg(c) over w m, stddev_pop(c) over w s0, count(c) over w k, min(c) over w = max(c) over w flat from b window w as ({_N} 19 preceding and current row)))"""
_add("bollinger", lambda spark, d: bars.bollinger(_valid(spark, d)), f'with {_CHECKED} select * exclude (dt), dt as "date" from ({_BOLL})')
_VOLT = f"""select symbol, dt, case when r then round(f, 6) end short_avg, case when r then round(m, 6) end long_avg, case when r then round(f / m, 4) end ratio,
  case when not r then 'none' when f / m > 1 then 'rising' when f / m < 1 then 'falling' else 'flat' end direction from (select *, coalesce(k = 20 and m > 0, false) r from (
  select *, avg(v) over ({_N} 4 preceding and current row) f, avg(v) over ({_N} 19 preceding and current row) m, count(v) over ({_N} 19 preceding and current row) k from b))"""
_add("volume_trend", lambda spark, d: bars.volume_trend(_valid(spark, d)), f'with {_CHECKED} select * exclude (dt), dt as "date" from ({_VOLT})')
_MACD = """ema as (select symbol, i, c f, c s, cast(0 as double) g from bn where i = 1
  union all select bn.symbol, bn.i, c * (2.0::double / 13) + f * (1 - 2.0::double / 13), c * (2.0::double / 27) + s * (1 - 2.0::double / 27),
    (c * (2.0::double / 13) + f * (1 - 2.0::double / 13) - c * (2.0::double / 27) - s * (1 - 2.0::double / 27)) * 0.2::double + g * 0.8::double from ema join bn on bn.symbol = ema.symbol and bn.i = ema.i + 1)"""
_add(
    "macd",
    lambda spark, d: bars.macd(_valid(spark, d)),
    f"""with recursive {_CHECKED}, {_BN}, {_MACD} select symbol, case when i >= 35 then 'OK' else 'FAIL_CLOSED' end status, case when i >= 35 then round(f - s, 6) end macd, case when i >= 35 then round(g, 6) end signal,
    case when i >= 35 then round(f - s - g, 6) end histogram from (select *, row_number() over (partition by symbol order by i desc) k from ema) where k = 1""",
)
_add(
    "indicator_report",
    lambda spark, d: bars.indicator_report(_valid(spark, d)),
    f"""with recursive {_CHECKED}, {_BN}, {_MACD}, las as (select symbol, max(dt) dt from b group by 1),
    m as (select symbol, i >= 35 ok, case when i >= 35 then round(f - s, 6) end macd, case when i >= 35 then round(g, 6) end signal from (select *, row_number() over (partition by symbol order by i desc) k from ema) where k = 1)
    select m.symbol, m.macd, m.signal, o.mid, o.percent_b, v.direction, case when m.ok and o.status = 'OK' and v.direction <> 'none' then 'OK' else 'FAIL_CLOSED' end status
    from m join las on las.symbol = m.symbol join ({_BOLL}) o on o.symbol = las.symbol and o.dt = las.dt join ({_VOLT}) v on v.symbol = las.symbol and v.dt = las.dt""",
)

# ---- backtest


def _signals(spark: SparkSession, d: str) -> DataFrame:
    """Every third valid bar signals with the label of its day, a seventh of them short; and all signals of the signal table,
    whose symbols have no bars."""
    rows = bars.valid_bars(table(spark, d, "outcomes_clusters"))
    third = rows.withColumn("n", F.row_number().over(bars.by_date())).where("n % 3 = 0")
    direction = F.when(F.col("row_id") % 7 == 0, "short").otherwise("long")
    own = third.select(F.concat(F.lit("b"), F.col("row_id").cast("string")).alias("signal_id"), "symbol", F.col("date").alias("signal_date"), direction.alias("direction"), F.col("setup_label").alias("setup_type"))
    named = table(spark, d, "signals").select("signal_id", "symbol", "signal_date", F.lower("direction").alias("direction"), "setup_type")
    return own.unionByName(named)


def _trades(spark: SparkSession, d: str, rules: backtest.BacktestRules = backtest.BacktestRules(5, 0.05, 0.03)) -> DataFrame:
    return backtest.backtest_trades(_valid(spark, d), _signals(spark, d), rules)


_SIGNALS = f"""bx as (select *, row_number() over (partition by symbol order by dt) i, count(*) over (partition by symbol) nb from (select ck.* exclude (row_id), r.row_id, r.setup_label from ck
    join outcomes_clusters r on r.symbol = ck.symbol and r."date" = ck.dt where len(errors) = 0)),
  sg as (select 'b' || row_id signal_id, symbol, dt signal_date, case when row_id % 7 = 0 then 'short' else 'long' end direction, setup_label from bx where i % 3 = 0
    union all select signal_id, symbol, signal_date, lower(direction), setup_type from signals),
  pl as (select sg.*, bx.i, bx.nb, case when sg.symbol not in (select symbol from bx) then 'symbol_mismatch' when coalesce(sg.direction, '') <> 'long' then 'unsupported_direction'
    when bx.i is null then 'date_not_found' when bx.i >= bx.nb then 'no_entry_bar' end skip from sg left join bx on bx.symbol = sg.symbol and bx.dt = sg.signal_date)"""
_TRADES = f"""{_SIGNALS}, held as (select pl.signal_id, pl.symbol, pl.signal_date, {_SETUP.replace('setup_label', 'pl.setup_label')} setup, pl.i + 1 entry, least(pl.i + 5, pl.nb) fin, pl.i + 5 fullfin, y.i pos, y.dt, y.o, y.h, y.l, y.c,
    first_value(y.o) over (partition by pl.signal_id order by y.i) price from pl join bx y on y.symbol = pl.symbol and y.i between pl.i + 1 and least(pl.i + 5, pl.nb) where skip is null),
  hit as (select *, case when l <= price * (1 - 0.03::double) then 'stop_loss' when h >= price * (1 + 0.05::double) then 'take_profit' end hit from held),
  ex as (select *, coalesce(min(pos) filter (where hit is not null) over (partition by signal_id), fin) ext from hit),
  tr as (select signal_id, symbol, signal_date, setup, min(dt) entry_date, round(any_value(price), 6) entry_price, max(dt) exit_date,
    round(max(case when pos = ext then case when hit = 'stop_loss' then price * (1 - 0.03::double) when hit = 'take_profit' then price * (1 + 0.05::double) else c end end), 6) exit_price,
    max(case when pos = ext then coalesce(hit, case when ext = fullfin then 'holding_period' else 'end_of_data' end) end) exit_reason, count(*) "days",
    round((max(case when pos = ext then case when hit = 'stop_loss' then price * (1 - 0.03::double) when hit = 'take_profit' then price * (1 + 0.05::double) else c end end) - any_value(price)) / any_value(price) * 100, 6) return_pct,
    round((min(l) - any_value(price)) / any_value(price) * 100, 6) drawdown_pct from ex where pos <= ext group by 1, 2, 3, 4)"""
_SUM = """count(*) trades, count(*) filter (where return_pct > 0) wins, count(*) filter (where not return_pct > 0) losses, round(count(*) filter (where return_pct > 0) / count(*), 6) win_rate,
  round(avg(return_pct), 4) avg_return_pct, round((case when min(1 + return_pct / 100) <= 0 then 0 else product(1 + return_pct / 100) end - 1) * 100, 3) cumulative_return_pct, round(avg("days"), 6) avg_days, min(drawdown_pct) max_drawdown_pct"""
_add("backtest_trades", _trades, f"with {_CHECKED}, {_TRADES} select * from tr")
_add(
    "backtest_skipped",
    lambda spark, d: backtest.backtest_skipped(_valid(spark, d), _signals(spark, d)),
    f"with {_CHECKED}, {_SIGNALS} select coalesce(skip, 'traded') reason, count(*) signals from pl group by 1",
)
_add("backtest_summary", lambda spark, d: backtest.backtest_summary(_trades(spark, d)), f"with {_CHECKED}, {_TRADES} select symbol, {_SUM} from tr group by 1")
_add("backtest_by_setup", lambda spark, d: backtest.backtest_by_setup(_trades(spark, d)), f"with {_CHECKED}, {_TRADES} select symbol, setup, {_SUM} from tr group by 1, 2")
_add(
    "setup_expectancy",
    lambda spark, d: backtest.setup_expectancy(_trades(spark, d)),
    f"""with {_CHECKED}, {_TRADES} select row_number() over (order by avg_return_pct desc, setup) "rank", setup, trades, win_rate, avg_return_pct,
    case when trades >= 30 and win_rate >= 0.55 and avg_return_pct / 100 >= 0.02 then 'STRONG' else 'DIAGNOSTIC_ONLY' end strength from (select setup, {_SUM} from tr group by 1)""",
)

# ---- merging and mapping


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Audit messages first, then events; an event's key is its identifier, a decision's its producer and signal."""
    audit, events = table(spark, d, "decision_audit_trail"), table(spark, d, "events_synthetic")
    own = lambda c: F.concat(F.lit(c), F.col("row_id").cast("string"))
    first = audit.select(F.col("row_id").alias("seq"), F.lit("audit").alias("source_bot"), merging.merge_key(F.lit("audit"), identifier(F.col("signal_id")), own("audit-row:")).alias("key"))
    second = events.select(F.col("row_id").alias("seq"), F.coalesce("source_bot", F.lit("?")).alias("source_bot"), F.coalesce(identifier(F.col("event_id")), own("event-row:")).alias("key"))
    return first, second


_SOURCES = f"""src as (select 0 priority, row_id seq, 'audit' source_bot, case when {identifier_sql("signal_id")} is not null then 'audit:' || {identifier_sql("signal_id")} else 'audit-row:' || row_id end k from decision_audit_trail
  union all select 1, row_id, coalesce(source_bot, '?'), coalesce({_ID}, 'event-row:' || row_id) from events_synthetic), kept as (select * from (select *, row_number() over (partition by k order by priority, seq) rn from src) where rn = 1)"""
_add("merge_sources", lambda spark, d: merging.merge_sources(*_sources(spark, d)), f"with {_SOURCES} select cast(priority as integer) priority, seq, source_bot, k as key from kept")
_add(
    "merge_stats",
    lambda spark, d: merging.merge_stats(*_sources(spark, d)),
    f"with {_SOURCES} select source_bot, count(*) loaded, count(*) filter (where rn = 1) kept, count(*) filter (where rn > 1) duplicates from (select *, row_number() over (partition by k order by priority, seq) rn from src) group by 1",
)
_add(
    "dedup_first_wins",
    lambda spark, d: merging.dedup_first_wins(table(spark, d, "recommendation_accuracy").select(F.col("row_id").alias("seq"), identifier(F.col("signal_id")).alias("signal"), "symbol", "outcome_pnl"), ["signal"]),
    f"select seq, signal, symbol, outcome_pnl from (select row_id seq, {identifier_sql('signal_id')} signal, symbol, outcome_pnl, row_number() over (partition by {identifier_sql('signal_id')} order by row_id) k from recommendation_accuracy) where k = 1",
)
_add(
    "dedup_last_wins",
    lambda spark, d: merging.dedup_last_wins(
        table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("seq")), ["l_orderkey", "l_linenumber"]
    ).select("l_orderkey", "l_linenumber", "seq.l_shipdate", "seq.l_partkey", "seq.l_suppkey", "seq.l_extendedprice"),
    """select l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice from (select *, row_number() over (partition by l_orderkey, l_linenumber
       order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_extendedprice desc, l_quantity desc) k from lineitem) where k = 1""",
)
_MAP = lambda column, known: "case " + " ".join(f"when upper(trim({column})) = '{a}' then '{b}'" for a, b in known.items()) + " end"
_add(
    "signal_outcome_lookup",
    lambda spark, d: merging.audit_events(table(spark, d, "decision_audit_trail"), table(spark, d, "recommendation_accuracy")),
    f"""with a as (select * from (select {identifier_sql("signal_id")} k, case when isfinite(outcome_pnl) then outcome_pnl end pnl, outcome_win ow, row_number() over (partition by {identifier_sql("signal_id")} order by row_id desc) rn
      from recommendation_accuracy) where rn = 1 and k is not null),
    j as (select t.*, {identifier_sql("t.signal_id")} sk, a.k, a.pnl, a.ow, upper(trim(final_decision)) fd from decision_audit_trail t left join a on a.k = {identifier_sql("t.signal_id")} where strategy_id <> ''),
    e as (select *, case when fd = 'ACCEPTED' and pnl is not null then 'TRADE_OUTCOME' when fd in ('REJECTED', 'SKIPPED') then 'REJECTION' else 'RECOMMENDATION' end event_type from j)
    select row_id, sk signal, strategy_id, event_type, {_MAP("regime", AUDIT_REGIMES)} regime, case when isfinite(score) then score end score,
      case when risk_reward_result.is_valid and isfinite(risk_reward_result.risk_reward_ratio) then round(risk_reward_result.risk_reward_ratio, 6) end expected_rr, pnl,
      case when k is null then case when event_type = 'RECOMMENDATION' then 'PENDING' end when ow then 'WIN' when not ow then 'LOSS' when pnl > 0 then 'WIN' when pnl is not null then 'LOSS' end outcome from e""",
)
_add(
    "trade_outcome_ingest",
    lambda spark, d: table(spark, d, "recommendation_accuracy").select("row_id", F.coalesce(F.nullif(F.col("strategy_id"), F.lit("")), F.lit("UNKNOWN")).alias("strategy_id"), safe_double(F.col("outcome_pnl").cast("string")).alias("pnl"), merging.outcome_of(safe_double(F.col("outcome_pnl").cast("string"))).alias("outcome")),
    """select row_id, coalesce(nullif(strategy_id, ''), 'UNKNOWN') strategy_id, p pnl, case when p is null then 'PENDING' when p > 0 then 'WIN' when p < 0 then 'LOSS' else 'BREAKEVEN' end outcome
       from (select *, case when isfinite(outcome_pnl) then outcome_pnl end p from recommendation_accuracy)""",
)
_add(
    "finite_coercion",
    lambda spark, d: table(spark, d, "events_synthetic").select("row_id", safe_double(F.col("realized_pnl").cast("string")).alias("pnl")).where("pnl is not null"),
    "select row_id, realized_pnl pnl from events_synthetic where isfinite(realized_pnl)",
)
_XREG = f"case when upper(trim(market_regime)) in ({_words(EXPORT_REGIMES)}) then upper(trim(market_regime)) else 'UNKNOWN' end"
_add(
    "regime_normalize",
    lambda spark, d: merging.regime_events(table(spark, d, "regime_export")),
    f"""select row_id, 'regime_' || lower(r) strategy_id, {_MAP("r", EXPORT_REGIMES)} regime, cast(c as integer) confidence, case when coalesce(data_is_real, false) then round(c / 100, 4) else 0.0 end score
    from (select *, {_XREG} r, greatest(0, least(100, coalesce(confidence, 0))) c from regime_export)""",
)

# ---- gates

_AS_OF = "2026-01-15 00:00:00"


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return floor.evidence_from_events(cut(tactical.tactical_events(table(spark, d, "events_synthetic")).select(*_CORE)))


def _floor(spark: SparkSession, d: str) -> DataFrame:
    judged = floor.statistical_floor(_evidence(spark, d), F.lit(_AS_OF).cast("timestamp"))
    return judged.select("strategy_id", "approved", "strength", F.array_join("refusals", ";").alias("refusals"))


_add(
    "statistical_floor",
    _floor,
    f"""with {TE}, s as (select *, round(wins / nullif(trade_outcomes, 0), 6) w from ({_STATS})), l as (select strategy_id, max(ts) p, bool_or(data_is_real) real from te group by 1),
    g as (select strategy_id, regime from (select *, row_number() over (partition by strategy_id order by n desc, f) k from (select strategy_id, regime, count(*) n, min(seq) f from te where regime <> '' group by 1, 2)) where k = 1),
    e as (select s.strategy_id, list_filter([case when trade_outcomes < 30 then 'sample_size_below_floor' end, case when avg_score is null then 'confidence_invalid' end, case when avg_score < 0.7 then 'confidence_below_floor' end,
      case when w is null then 'edge_or_win_rate_missing' end, case when w < 0.55 then 'win_rate_below_floor' end, case when not real then 'data_not_real' end, case when p > timestamp '{_AS_OF}' then 'produced_at_future' end,
      case when p <= timestamp '{_AS_OF}' and date_diff('microsecond', p, timestamp '{_AS_OF}') / 3.6e9 > 168 then 'evidence_stale' end,
      case when coalesce(upper(trim(regime)), 'UNKNOWN') not in ({_words(FLOOR_REGIMES)}) then 'regime_unknown_or_unsupported' end, case when regime is null then 'regime_not_verified' end], lambda x: x is not null) r
      from s join l on l.strategy_id = s.strategy_id left join g on g.strategy_id = s.strategy_id)
    select strategy_id, len(r) = 0 approved, case when len(r) = 0 then 'STRONG' else 'DIAGNOSTIC_ONLY' end strength, array_to_string(r, ';') refusals from e""",
)


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """A week of events plays the part of a run."""
    events = tactical.tactical_events(table(spark, d, "events_synthetic")).withColumn("run", F.to_date(F.date_trunc("week", "ts")))
    won = F.count_if(tactical.is_trade() & (F.col("outcome") == "WIN"))
    return events.groupBy("run").agg(F.count("*").alias("total_events"), ratio(won, F.count_if(tactical.is_trade())).alias("win_rate"))


_RUNS = "runs as (select cast(date_trunc('week', ts) as date) run, count(*) n, count(*) filter (where trade and outcome = 'WIN') / nullif(count(*) filter (where trade), 0) w from te group by 1)"
_add(
    "cross_run_trend",
    lambda spark, d: trend.cross_run_trend(_runs(spark, d)),
    f"""with {TE}, {_RUNS} select run, compared, round(w, 6) win_rate, round(w - uw, 6) win_rate_delta, coalesce(abs(w - uw) >= 0.05, false) win_rate_shift, round((n - un) / nullif(un, 0), 6) volume_delta,
    coalesce(abs((n - un) / nullif(un, 0)) >= 0.30, false) volume_shift from (select *, count(*) over p compared, avg(w) over p uw, avg(n) over p un from runs window p as (order by run rows between 5 preceding and 1 preceding)) where compared > 0""",
)


def _mix(spark: SparkSession, d: str) -> DataFrame:
    events = tactical.tactical_events(table(spark, d, "events_synthetic")).where(tactical.is_trade()).withColumn("run", F.to_date(F.date_trunc("week", "ts")))
    return trend.trend_strategy_mix(events.groupBy("run", "strategy_id").agg(F.count("*").alias("trades")))


_add(
    "trend_strategy_mix",
    _mix,
    f"""with {TE}, t as (select * from (select *, row_number() over (partition by run order by n desc, strategy_id) k from (select cast(date_trunc('week', ts) as date) run, strategy_id, count(*) n from te where trade group by 1, 2)) where k <= 5),
    p as (select * from (select run, lag(run) over (order by run) b from (select distinct run from t)) where b is not null)
    select p.run, t.strategy_id, 'added' change from p join t on t.run = p.run where not exists (select 1 from t x where x.run = p.b and x.strategy_id = t.strategy_id)
    union all select p.run, t.strategy_id, 'removed' from p join t on t.run = p.b where not exists (select 1 from t x where x.run = p.run and x.strategy_id = t.strategy_id)""",
)
_add(
    "provenance",
    lambda spark, d: tactical.tactical_events(table(spark, d, "events_synthetic")).where(tactical.is_trade()).groupBy("source_bot").agg(F.count_if("data_is_real").alias("real_outcomes"), F.count("*").alias("outcomes")),
    f"with {TE} select source_bot, count(*) filter (where data_is_real) real_outcomes, count(*) outcomes from te where trade group by 1",
)

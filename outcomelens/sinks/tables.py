"""Append-only run tables (baselines, history, run log, errors) and the result snapshot.

Each append writes new files and never rewrites old ones; run numbers are given when the table is read, so concurrent
writers do not collide."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from outcomelens.operators import performance
from outcomelens.sources.files import exists


def append(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("append").parquet(path)


def read_all(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if exists(spark, path) else None


def _stamped(rows: DataFrame, at: datetime) -> DataFrame:
    return rows.withColumn("run_at", F.lit(at.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp"))


def append_baseline(events: DataFrame, path: str, at: datetime) -> None:
    append(_stamped(performance.baseline_snapshot(events), at), path)


def append_history(events: DataFrame, path: str, at: datetime) -> None:
    append(_stamped(performance.executive_summary(events), at), path)


def append_run_log(events: DataFrame, path: str, at: datetime, seconds: float) -> None:
    append(_stamped(performance.counts_by(events, "event_type"), at).withColumn("duration_seconds", F.lit(float(seconds))), path)


def append_errors(errors: DataFrame, path: str, at: datetime) -> None:
    append(_stamped(errors, at), path)


#: Kinds of the typed event log and what each carries.
LOG_KINDS = {
    "ANALYSIS_RUN": "events bigint, strategies bigint",
    "ADAPTER_ERROR": "file string, error string",
    "SOURCE_STALE": "source string, age_hours double",
    "RECOMMENDATION_PRODUCED": "strategy_id string, strength string",
}


def log_event(spark: SparkSession, path: str, kind: str, at: datetime, payload: dict) -> None:
    """One line of the typed event log, appended as JSON."""
    if kind not in LOG_KINDS:
        raise ValueError(kind)
    fields = [f.split()[0] for f in LOG_KINDS[kind].split(", ")]
    row = spark.createDataFrame([(kind, at.replace(tzinfo=None).isoformat(), json.dumps({f: payload.get(f) for f in fields}, sort_keys=True))], "kind string, at string, payload string")
    row.coalesce(1).write.mode("append").json(path)


def history(spark: SparkSession, path: str) -> DataFrame | None:
    """All runs with their number, in order of time."""
    rows = read_all(spark, path)
    return None if rows is None else rows.withColumn("run_count", F.row_number().over(Window.orderBy("run_at")))


def runs_of(baselines: DataFrame) -> DataFrame:
    """Baselines as the runs that gates.trend compares: (run, total_events, win_rate)."""
    value = lambda metric: F.max(F.when((F.col("metric") == metric) & (F.col("subject") == ""), F.col("value")))
    return baselines.groupBy(F.col("run_at").alias("run")).agg(value("total_events").alias("total_events"), value("overall_win_rate").alias("win_rate"))


def snapshot(events: DataFrame, input_source: str, data_is_real: bool, at: datetime | None = None) -> dict:
    """The canonical result envelope; fresh for 24 hours."""
    at = at or datetime.now(timezone.utc)
    row = performance.result_snapshot(events).first().asDict()
    return {
        "schema_version": "1.0", "produced_at": at.isoformat(), "fresh_until": (at + timedelta(hours=24)).isoformat(), "input_source": input_source, "data_is_real": bool(data_is_real),
        "advisory_only": True, "broker_execution": False, "live_trading_active": False, "status": row["status"], "payload": row,
    }


REQUIRED = ("schema_version", "produced_at", "fresh_until", "input_source", "data_is_real", "advisory_only", "broker_execution", "live_trading_active", "status", "payload")


def conformance(envelope: dict) -> list[str]:
    """What is wrong with an envelope: missing keys, or flags that are not literally what they must be."""
    problems = [f"missing {key}" for key in REQUIRED if key not in envelope]
    fixed = {"advisory_only": True, "broker_execution": False, "live_trading_active": False}
    return problems + [f"{key} is not {value}" for key, value in fixed.items() if key in envelope and envelope[key] is not value]


def write_json(value: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, sort_keys=True, ensure_ascii=True, indent=2, default=str), encoding="ascii")

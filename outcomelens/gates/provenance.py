"""Where a run's events come from, and whether they may be called real. Anything unproven is not real."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from outcomelens.operators.events import is_trade
from outcomelens.sources import files

# Names of sources and of their mixtures.
GENERIC, STOCK, OPTIONS, NONE = "generic", "stock_outcomes", "options_advisory", "none"


OPTIONS_SNAPSHOT = "data/reports/source_snapshot.json"
OPTIONS_HOURS = 36


def assess_options(spark: SparkSession, folder: str | None, as_of: datetime, hours: float = OPTIONS_HOURS) -> list[str]:
    """What speaks against an options folder: missing files, an unreadable snapshot, flags that are not literally set, age.
    An empty list means the folder is as it should be."""
    if not folder or not files.exists(spark, folder):
        return ["folder missing"]
    absent = [name for name in (files.AUDIT_FILE, files.ACCURACY_FILE) if not files.exists(spark, f"{folder}/{name}")]
    if absent:
        return [f"missing {name}" for name in absent]
    if not files.exists(spark, f"{folder}/{OPTIONS_SNAPSHOT}"):
        return ["snapshot missing"]
    text = spark.read.text(f"{folder}/{OPTIONS_SNAPSHOT}", wholetext=True).first()
    try:
        snapshot = json.loads(text.value if text else "")
    except ValueError:
        return ["snapshot unreadable"]
    if not isinstance(snapshot, dict):
        return ["snapshot is no object"]
    problems = [] if snapshot.get("broker_execution_enabled") is False else ["broker execution not declared off"]
    problems += [] if snapshot.get("data_is_real") is True else ["data not declared real"]
    try:
        made = datetime.fromisoformat(str(snapshot.get("produced_at")).strip().replace("Z", "+00:00"))
    except ValueError:
        return [*problems, "no readable time"]
    made = made if made.tzinfo else made.replace(tzinfo=timezone.utc)
    age = (as_of - made).total_seconds() / 3600
    return problems + (["older than allowed"] if age > hours else ["from the future"] if age < 0 else [])


def real_stock_outcomes(events: DataFrame, stock_source: str) -> DataFrame:
    """One row: trade outcomes of the stock source that carry a true data_is_real flag."""
    return events.where(is_trade() & (F.col("source_bot") == stock_source)).agg(F.count_if("data_is_real").alias("real_outcomes"), F.count("*").alias("outcomes"))


def decide(has_generic: bool, has_stock: bool, has_options: bool, real_outcomes: int) -> tuple[str, bool, list[str]]:
    """(input_source, data_is_real, reasons): generic input taints a run, options alone never count as real, stock input is
    real from one real outcome on."""
    names = [name for name, there in ((STOCK, has_stock), (OPTIONS, has_options), (GENERIC, has_generic)) if there]
    source = "+".join(names) or NONE
    if has_generic:
        return source, False, ["generic input: provenance cannot be verified"]
    if has_stock:
        verified = real_outcomes > 0
        reasons = [f"{real_outcomes} real stock outcomes" if verified else "no real stock outcome"]
        return source, verified, reasons + (["options stream is advisory and does not count"] if has_options else [])
    if has_options:
        return source, False, ["options stream is advisory"]
    return source, False, ["no source given"]

"""One analysis run: read the sources, analyse, render, and append the run's artifacts."""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from outcomelens.gates import provenance, trend
from outcomelens.operators import performance
from outcomelens.operators.events import is_trade
from outcomelens.report import render, sections
from outcomelens.session import cut
from outcomelens.sinks import tables
from outcomelens.sources import files


@dataclass
class Run:
    events: DataFrame
    errors: DataFrame
    rejected: DataFrame
    input_source: str
    data_is_real: bool
    reasons: list[str]


def load(spark: SparkSession, options: str | None = None, trades: str | None = None, generic: str | None = None, worker: str | None = None, regime: str | None = None, at: datetime | None = None) -> Run:
    """All given sources in order of priority (options, trades, generic, worker snapshot, regime export), without deduplication
    between them; `at`: the time the regime export is judged at."""
    as_of = (at or datetime.now(timezone.utc)).astimezone(timezone.utc).replace(tzinfo=None).isoformat(sep=" ")
    parts = [files.read_options(spark, options), files.read_trades(spark, trades), files.read_generic(spark, generic)]
    parts += [files.read_worker_snapshot(spark, worker), files.read_regime_export(spark, regime, as_of)]
    events, errors = None, None
    for priority, part in enumerate(parts):
        ranked = part.events.withColumn("priority", F.lit(priority))
        events = ranked if events is None else events.unionByName(ranked)
        errors = part.errors if errors is None else errors.unionByName(part.errors)
    # a total order over all sources; events without a time of their own come first
    order = F.concat(F.lpad(F.col("priority").cast("string"), 2, "0"), F.lpad(F.col("seq").cast("string"), 20, "0"))
    ranked = cut(events.withColumn("place", order).drop("seq", "priority"))
    numbered = ranked.withColumn("seq", F.conv(F.substring(F.col("place"), 1, 2), 10, 10).cast("bigint") * F.lit(1 << 58) + F.substring("place", 3, 20).cast("bigint")).drop("place")
    valid, rejected = files.quarantine(numbered)
    stock = valid.where(is_trade() & (F.col("source_bot") == "stock_stream")).agg(F.count_if("data_is_real").alias("n")).first().n if trades else 0
    source, real, reasons = provenance.decide(bool(generic), bool(trades), bool(options), stock)
    return Run(valid, errors, rejected, source, real, reasons)


def run(spark: SparkSession, out: str, name: str = "report", at: datetime | None = None, **sources: str | None) -> dict[str, str]:
    """Writes the report and six artifacts below `out`; returns their paths."""
    began, at = time.time(), at or datetime.now(timezone.utc)
    loaded = load(spark, at=at, **sources)
    folder = Path(out)
    folder.mkdir(parents=True, exist_ok=True)
    paths = {
        "report": str(folder / f"{name}.md"), "dashboard": str(folder / "dashboard.html"), "snapshot": str(folder / "result_snapshot.json"),
        "history": str(folder / "run_history"), "baselines": str(folder / "baselines"), "run_log": str(folder / "run_log"), "errors": str(folder / "errors"),
    }
    head = [f"Produced {at.isoformat()}  ", f"Source: {loaded.input_source}  ", f"Real data: {'yes' if loaded.data_is_real else 'no'} ({'; '.join(loaded.reasons)})  ", "Advisory only: no trades, no changes."]
    shown = sections.event_sections(loaded.events)
    shown += sections.floor_sections(loaded.events, F.lit(at.astimezone(timezone.utc).replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp"))
    if sources.get("options") and sources.get("trades"):
        streams = loaded.events.where(F.col("source_bot").isin("options_stream", "stock_stream")).withColumn("stream", F.col("source_bot"))
        shown += sections.correlation_sections(streams, "stock_stream", "options_stream")
    if sources.get("options"):
        shown += [render.fetch(name.replace("_", " ").capitalize(), rows) for name, rows in files.supplements(spark, sources["options"]).items()]
    if (earlier := tables.read_all(spark, paths["baselines"])) is not None:
        now = performance.executive_summary(loaded.events).select(F.lit(at.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp").alias("run"), "total_events", "win_rate")
        runs = tables.runs_of(earlier).select("run", F.col("total_events").cast("bigint").alias("total_events"), "win_rate").unionByName(now.withColumn("total_events", F.col("total_events").cast("bigint")))
        shown += [render.fetch("Against earlier runs", trend.cross_run_trend(runs), [F.desc("run")], 1)]
    given = [(name, "given" if sources.get(name) else "absent") for name in ("options", "trades", "generic", "worker", "regime")]
    shown += [render.Table("Diagnostics", ["source", "state"], given)]
    shown += [render.fetch("Rejected records", loaded.rejected, ["invalid"]), render.fetch("Source errors", loaded.errors, ["file"], 20)]
    Path(paths["report"]).write_text(render.markdown(shown, "Trade outcome analytics", head), encoding="utf-8")
    Path(paths["dashboard"]).write_text(render.dashboard(sections.dashboard_sections(loaded.events), "Trade outcomes"), encoding="utf-8")
    envelope = tables.snapshot(loaded.events, loaded.input_source, loaded.data_is_real, at)
    if problems := tables.conformance(envelope):
        raise RuntimeError("; ".join(problems))
    tables.write_json(envelope, paths["snapshot"])
    tables.append_history(loaded.events, paths["history"], at)
    tables.append_baseline(loaded.events, paths["baselines"], at)
    tables.append_errors(loaded.errors, paths["errors"], at)
    tables.append_run_log(loaded.events, paths["run_log"], at, time.time() - began)
    return paths

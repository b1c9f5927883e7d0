"""Readers of JSON, JSON lines, CSV and log exports: each yields events (or rows) and the errors met on the way.

Absent folders and files give empty results, never exceptions. Every row carries `seq`, its order of reading, which is unique
within its source: format, file (by name) and place in the file, in that order of bits. A record
that cannot be read becomes an error row (file, error, sample); one that breaks the event rules is counted by
quarantine(). Records are maps of texts, so NaN and Infinity in JSON are read as texts and come out null."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from outcomelens.functions.exprs import finite, label, mapped, safe_double
from outcomelens.operators.events import invalid_reason
from outcomelens.operators.merging import dedup_first_wins, dedup_last_wins, outcome_of
from outcomelens.schema import AUDIT_REGIMES, EVENT_TYPES, EXPORT_REGIMES, PENDING, RECOMMENDATION, REGIME_CHANGE, REJECTION, SYSTEM_EVENT, TRADE_OUTCOME

EVENTS = (
    "seq bigint, event_id string, ts timestamp, source_bot string, event_type string, strategy_id string, regime string, score double, expected_rr double, "
    "pnl double, outcome string, symbol string, setup_type string, data_is_real boolean, metadata string"
)
ERRORS = "file string, error string, sample string"

#: Alternative names of a field, the first that holds something counts.
ALIASES = {
    "strategy_id": ("strategy_id", "strategy", "tactic", "trade_type"),
    "event_type": ("event_type", "type"),
    "regime": ("regime", "market_regime"),
    "outcome": ("outcome", "result"),
    "score": ("score", "confidence"),
    "expected_rr": ("expected_rr", "rr", "risk_reward"),
    "pnl": ("realized_pnl", "pnl", "profit_loss"),
}
RECORD_LISTS = ("events", "trades", "outcomes", "records")
PNL_FIELDS = ("netto_pnl", "pnl_abs", "profit_abs", "realized_pnl")
REAL_MODES = ("LIVE", "LIVE_RECONCILED")
SNAPSHOT_BYTES = 65_536


@dataclass
class Source:
    """What a reader found: events, errors, and whether its place was there at all."""

    events: DataFrame
    errors: DataFrame
    present: bool = True


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def listed(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Files of a folder by pattern, in order of name."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return sorted(str(s.getPath()) for s in found) if found else []


PLACE_BITS, FILE_BITS = 38, 18


def ranks(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file_name, rank) of files in order of name; refuses what `seq` has no room for."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    if len(files) >= 1 << FILE_BITS:
        raise ValueError(f"more than {1 << FILE_BITS} files in one folder")
    for path in map(hadoop.Path, files):
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen() >= 1 << PLACE_BITS:
            raise ValueError(f"too large to number its records: {path}")
    return spark.createDataFrame(pa.table({"file_name": [path.rsplit("/", 1)[-1] for path in files], "rank": pa.array(range(len(files)), pa.int64())}))


def line_place() -> Column:
    """The place of a line: where its block begins and which row of the task it is. A line has at least one byte, so places
    rise along a file and none occurs twice in it."""
    return F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def in_order(rows: DataFrame, spark: SparkSession, files: list[str], part: int) -> DataFrame:
    """rows (file, place, ...) with seq instead of place; part: the place of their format in the source (0 to 3)."""
    if len(files) == 1:
        return rows.withColumn("seq", F.lit(part << (PLACE_BITS + FILE_BITS)) + F.col("place").cast("bigint")).drop("place")
    named = rows.withColumn("file_name", F.element_at(F.split(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), "/"), -1))
    joined = named.join(ranks(spark, files), "file_name", "left").drop("file_name")
    seq = F.lit(part << (PLACE_BITS + FILE_BITS)) + F.shiftleft(F.coalesce("rank", F.lit(0)), PLACE_BITS) + F.col("place").cast("bigint")
    return joined.withColumn("seq", seq).drop("rank", "place")


def nothing(spark: SparkSession, present: bool = False) -> Source:
    return Source(spark.createDataFrame([], EVENTS), spark.createDataFrame([], ERRORS), present)


def _failed(rows: DataFrame, error: str, text: str = "value") -> DataFrame:
    return rows.select(F.col("file"), F.lit(error).alias("error"), F.substring(text, 1, 160).alias("sample"))


def json_lines(spark: SparkSession, path: str, schema: str, part: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of a splittable file of JSON objects, one a line; blank lines are skipped."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), line_place().alias("place"))
    lines = in_order(lines, spark, [path], part)
    read = lines.where(F.btrim("value") != "").withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    good = F.startswith(F.ltrim("value"), F.lit("{")) & F.col("r").isNotNull() & F.get_json_object("value", "$").isNotNull()
    return read.where(good).select("seq", "file", "value", "r.*"), _failed(read.where(~good), "not a JSON object")


# ---- generic folder


def _truthy(value: Column, zero_is_empty: bool) -> Column:
    """The value where it says something; in JSON a plain zero does not (as in an or-chain), in CSV it does."""
    empty = value.isin("", "null", "false", "[]", "{}")
    if zero_is_empty:
        empty = empty | F.coalesce(value.try_cast("double") == 0, F.lit(False))
    return F.when(~empty, value)


def generic_events(records: DataFrame, source: str = "UNKNOWN", zero_is_empty: bool = True) -> DataFrame:
    """Records (seq, file, r: map of texts) as events. An unknown event type counts as a trade outcome. The record's own
    timestamp and identifier are kept where they are there; else the identifier is made of file and place."""
    def first(field: str) -> Column:
        return F.coalesce(*[_truthy(F.try_element_at("r", F.lit(name)), zero_is_empty) for name in ALIASES[field]])

    kind = F.upper(F.coalesce(first("event_type"), F.lit(TRADE_OUTCOME)))
    known = [name for names in ALIASES.values() for name in names] + ["event_id", "timestamp"]
    rest = F.map_filter("r", lambda k, v: ~k.isin(*known))
    flag = F.try_element_at("r", F.lit("data_is_real")) == "true"
    at = lambda name: F.try_element_at("r", F.lit(name))
    return records.select(
        "seq", F.coalesce(_truthy(at("event_id"), False), F.sha2(F.concat_ws("#", "file", F.col("seq").cast("string")), 256)).alias("event_id"),
        at("timestamp").try_cast("timestamp").alias("ts"), F.lit(source).alias("source_bot"), F.when(kind.isin(*EVENT_TYPES), kind).otherwise(TRADE_OUTCOME).alias("event_type"),
        F.coalesce(first("strategy_id"), F.lit("unknown")).alias("strategy_id"), F.upper(first("regime")).alias("regime"), safe_double(first("score")).alias("score"),
        safe_double(first("expected_rr")).alias("expected_rr"), safe_double(first("pnl")).alias("pnl"), F.upper(first("outcome")).alias("outcome"),
        label(at("symbol")).alias("symbol"), at("setup_type").alias("setup_type"), F.coalesce(flag, F.lit(False)).alias("data_is_real"), F.to_json(rest).alias("metadata"),
    )


def _json_files(spark: SparkSession, files: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records of whole JSON files: a list, the first record list of an object, or the object itself."""
    whole = spark.read.text(files, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    many = "array<map<string,string>>"
    top = F.from_json("value", "map<string,string>")
    inner = F.coalesce(*[F.when(F.startswith(F.ltrim(F.try_element_at("o", F.lit(k))), F.lit("[")), F.from_json(F.try_element_at("o", F.lit(k)), many)) for k in RECORD_LISTS])
    is_list, is_object = F.startswith(F.ltrim("value"), F.lit("[")), F.startswith(F.ltrim("value"), F.lit("{"))
    read = whole.withColumn("o", F.when(is_object, top)).withColumn(
        "records", F.when(is_list, F.from_json("value", many)).when(F.col("o").isNotNull(), F.coalesce(inner, F.array("o")))
    )
    rows = read.select("file", F.posexplode("records").alias("pos", "r")).where("r is not null")
    return in_order(rows.withColumnRenamed("pos", "place"), spark, files, 0).select("seq", "file", "r"), _failed(read.where("records is null"), "not readable as JSON")


def _csv_files(spark: SparkSession, files: list[str]) -> DataFrame | None:
    """Records of CSV files with a header; files with the same header are read together."""
    headers = spark.read.text(files, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", r"\r?\n")[0].alias("h")).collect() if files else []
    out = None
    for header in sorted({r.h for r in headers}):
        rows = spark.read.csv([r.file for r in headers if r.h == header], header=True, inferSchema=False, enforceSchema=False)
        pairs = [x for c in rows.columns for x in (F.lit(c), F.col(f"`{c}`"))]
        part = rows.select(line_place().alias("place"), F.col("_metadata.file_path").alias("file"), F.create_map(*pairs).alias("r"))
        out = part if out is None else out.unionByName(part)
    return out if out is None else in_order(out, spark, files, 1)


def read_generic(spark: SparkSession, folder: str | None, source: str = "UNKNOWN") -> Source:
    """Every *.json, *.csv and *.log file of a folder (not of its subfolders)."""
    if not folder or not exists(spark, folder):
        return nothing(spark)
    found = nothing(spark, present=True)
    if files := listed(spark, folder, "*.json"):
        rows, errors = _json_files(spark, files)
        found.events, found.errors = found.events.unionByName(generic_events(rows, source)), found.errors.unionByName(errors)
    if (rows := _csv_files(spark, listed(spark, folder, "*.csv"))) is not None:
        found.events = found.events.unionByName(generic_events(rows, source, zero_is_empty=False))
    if files := listed(spark, folder, "*.log"):
        lines = spark.read.text(files).select("value", F.col("_metadata.file_path").alias("file"), line_place().alias("place"))
        read = in_order(lines, spark, files, 2).where(F.startswith(F.btrim("value"), F.lit("{"))).withColumn("r", F.from_json("value", "map<string,string>"))
        found.events = found.events.unionByName(generic_events(read.where("r is not null"), source))
        found.errors = found.errors.unionByName(_failed(read.where("r is null"), "not a JSON object"))
    return found


def quarantine(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events, counts per broken rule)."""
    # a record without a time of its own is valid here: files order it
    at = F.coalesce("ts", F.lit("1970-01-01").cast("timestamp"))
    broken = events.withColumn("invalid", invalid_reason(F.col("source_bot"), F.col("event_type"), F.col("strategy_id"), at, F.col("score")))
    return broken.where("invalid is null").drop("invalid"), broken.where("invalid is not null").groupBy("invalid").agg(F.count("*").alias("events"))


def _shaped(rows: DataFrame, **columns: Column) -> DataFrame:
    """The event schema, with nulls for what is not given."""
    given = {"data_is_real": F.lit(False)} | columns
    kinds = dict(part.strip().rsplit(" ", 1) for part in EVENTS.split(","))
    return rows.select(*[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()])


# ---- options folder

AUDIT = (
    "signal_id string, recommendation_id string, symbol string, strategy_id string, cycle_id string, timestamp string, advisory_only boolean, regime string, iv_rank double, "
    "dte int, delta double, score double, risk_reward_result struct<is_valid boolean, risk_reward_ratio double>, final_decision string, reason_codes array<string>, human_explanation string"
)
ACCURACY = "recommendations array<struct<signal_id string, outcome_pnl double, outcome_win boolean>>"
CHAIN = "decision string, option_contract string, rejection_reason string, symbol string, timestamp string"
AUDIT_FILE, SUMMARY_FILE = "data/logs/decision_audit_trail.jsonl", "data/reports/audit_summary.json"
CHAIN_FILE, ACCURACY_FILE = "data/logs/options_events.jsonl", "data/reports/recommendation_accuracy.json"
SUPPLEMENTS = ("strategy_performance", "regime_performance", "lifecycle_summary")


def _lookup(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], "signal_id string, known boolean, pnl double, outcome_win boolean")
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", ACCURACY)["recommendations"]).alias("seq", "a")).select("seq", "a.*")
    last = dedup_last_wins(rows.where("signal_id <> ''"), ["signal_id"])
    return last.select("signal_id", F.lit(True).alias("known"), finite(F.col("outcome_pnl")).alias("pnl"), "outcome_win")


def read_options(spark: SparkSession, folder: str | None, source: str = "options_stream") -> Source:
    """Decisions with their reported outcomes, and rejections of the option chain (first row per contract). The summary of
    the audit trail stands in only where the trail itself is missing."""
    if not folder or not exists(spark, folder):
        return nothing(spark)
    found = nothing(spark, present=True)
    trail, summary = f"{folder}/{AUDIT_FILE}", f"{folder}/{SUMMARY_FILE}"
    rows = None
    if exists(spark, trail):
        rows, errors = json_lines(spark, trail, AUDIT)
        found.errors = found.errors.unionByName(errors)
    elif exists(spark, summary):
        whole = spark.read.text(summary, wholetext=True).select(F.posexplode(F.from_json("value", f"entries array<struct<{', '.join(AUDIT.split(', '))}>>")["entries"]).alias("seq", "e"))
        rows = whole.select("seq", "e.*")
    if rows is not None:
        joined = rows.where("strategy_id <> ''").join(_lookup(spark, f"{folder}/{ACCURACY_FILE}"), "signal_id", "left")
        decision = F.upper("final_decision")
        kind = F.when((decision == "ACCEPTED") & F.col("pnl").isNotNull(), TRADE_OUTCOME).when(decision.isin("REJECTED", "SKIPPED"), REJECTION).otherwise(RECOMMENDATION)
        outcome = F.when(F.col("outcome_win"), "WIN").when(~F.col("outcome_win"), "LOSS").when(F.col("pnl") > 0, "WIN").when(F.col("pnl").isNotNull(), "LOSS")
        outcome = F.when(F.col("known"), outcome).when(kind == RECOMMENDATION, PENDING)
        rr = F.when(F.col("risk_reward_result.is_valid"), finite(F.col("risk_reward_result.risk_reward_ratio")))
        meta = F.to_json(F.struct("signal_id", "symbol", "cycle_id", "iv_rank", "dte", "delta", "reason_codes", "human_explanation", "advisory_only"))
        regime = mapped(F.col("regime"), AUDIT_REGIMES, F.lit(None).cast("string"))
        found.events = found.events.unionByName(_shaped(
            joined, seq=F.col("seq"), event_id=F.concat(F.lit("audit:"), "signal_id"), ts=F.col("timestamp").try_cast("timestamp"), source_bot=F.lit(source), event_type=kind,
            strategy_id=F.col("strategy_id"), regime=regime, score=finite(F.col("score")), expected_rr=rr, pnl=F.col("pnl"), outcome=outcome, symbol=label(F.col("symbol")), metadata=meta,
        ))
    chain = f"{folder}/{CHAIN_FILE}"
    if exists(spark, chain):
        rows, errors = json_lines(spark, chain, CHAIN, part=1)
        rejected = dedup_first_wins(rows.where(F.upper("decision") == "REJECT").withColumn("option_contract", F.coalesce("option_contract", F.lit(""))), ["option_contract"])
        found.events = found.events.unionByName(_shaped(
            rejected, seq=F.col("seq"), event_id=F.concat(F.lit("chain:"), "option_contract"), ts=F.col("timestamp").try_cast("timestamp"), source_bot=F.lit(source), event_type=F.lit(REJECTION),
            strategy_id=F.concat(F.lit("chain_filter_"), F.coalesce("symbol", F.lit("UNKNOWN"))), symbol=label(F.col("symbol")), metadata=F.to_json(F.struct("option_contract", "rejection_reason")),
        ))
        found.errors = found.errors.unionByName(errors)
    return found


def supplements(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Supplementary reports as they are, by name; those that are missing are left out."""
    paths = {name: f"{folder}/data/reports/{name}.json" for name in SUPPLEMENTS}
    return {name: spark.read.json(path, multiLine=True) for name, path in paths.items() if exists(spark, path)}


# ---- trade log, worker snapshot, regime export

TRADE = (
    "event_type string, timestamp string, data struct<execution_mode string, strategy string, setup_type string, netto_pnl string, pnl_abs string, profit_abs string, realized_pnl string, "
    "pnl_pct double, ticker string, trade_id string, exec_ids string, sell_reason string, timestamp string>"
)


def read_trades(spark: SparkSession, path: str | None, source: str = "stock_stream") -> Source:
    """Closed trades of an append-only log; a trade that was logged again counts with its last line."""
    if not path or not exists(spark, path):
        return nothing(spark)
    rows, errors = json_lines(spark, path, TRADE)
    sold = rows.where("event_type = 'SELL_EXECUTED'")
    pnl = F.coalesce(*[safe_double(F.col(f"data.{name}")) for name in PNL_FIELDS])
    flat = sold.select(
        "seq", F.nullif(F.col("data.trade_id"), F.lit("")).alias("trade_id"), F.nullif(F.col("data.exec_ids"), F.lit("")).alias("exec_ids"), pnl.alias("pnl"), "data",
        F.coalesce(F.col("data.timestamp").try_cast("timestamp"), F.col("timestamp").try_cast("timestamp")).alias("at"),
    )
    last = dedup_last_wins(flat, ["trade_id", "exec_ids"])
    some = lambda c: F.nullif(F.btrim(c), F.lit(""))
    real = F.coalesce(label(F.col("data.execution_mode")).isin(*REAL_MODES), F.lit(False))
    events = _shaped(
        last, seq=F.col("seq"), event_id=F.concat_ws(":", F.lit("trade"), F.coalesce("trade_id", F.col("seq").cast("string")), "exec_ids"), ts=F.col("at"), source_bot=F.lit(source),
        event_type=F.lit(TRADE_OUTCOME), strategy_id=F.coalesce(some("data.strategy"), some("data.setup_type"), F.lit("UNKNOWN")), pnl=F.col("pnl"), outcome=outcome_of(F.col("pnl")),
        symbol=label(F.col("data.ticker")), setup_type=F.col("data.setup_type"), data_is_real=real, metadata=F.to_json("data"),
    )
    return Source(events, errors)


WORKER = "status string, worker_entrypoint_status string, completed_at string, worker_entrypoint struct<status string, final_status string, queue_total int, errors array<string>>"
EXPORT = (
    "generated_at string, produced_at string, market_regime string, confidence double, risk_level string, volatility_env string, input_source string, data_is_real boolean, reason array<string>"
)


def _small(spark: SparkSession, path: str) -> DataFrame:
    """The text of a snapshot file; snapshots beyond SNAPSHOT_BYTES are refused."""
    file = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length", F.decode("content", "UTF-8").alias("value"))
    return file.withColumn("ok", F.col("length") <= SNAPSHOT_BYTES)


def read_worker_snapshot(spark: SparkSession, path: str | None, source: str = "worker") -> Source:
    """One system event: health 1 for a clean run, 0.5 for a partial one, 0 for anything else."""
    if not path or not exists(spark, path):
        return nothing(spark)
    read = _small(spark, path).withColumn("r", F.when(F.col("ok"), F.from_json("value", WORKER)))
    status = F.upper(F.coalesce("r.worker_entrypoint_status", "r.worker_entrypoint.final_status", "r.status", F.lit("")))
    failed = F.size(F.coalesce("r.worker_entrypoint.errors", F.array().cast("array<string>"))) > 0
    health = F.when(status.isin("OK", "SUCCESS", "READY", "COMPLETED") & ~failed, 1.0).when(status.isin("OK", "SUCCESS", "READY", "COMPLETED", "PARTIAL", "DEGRADED"), 0.5).otherwise(0.0)
    events = _shaped(
        read.where("r is not null"), seq=F.lit(0), event_id=F.sha2("value", 256), ts=F.col("r.completed_at").try_cast("timestamp"), source_bot=F.lit(source), event_type=F.lit(SYSTEM_EVENT),
        strategy_id=F.lit("worker_health"), score=health, metadata=F.to_json("r"),
    )
    return Source(events, _failed(read.where("r is null"), "not a readable snapshot"))


def freshness(at: Column, as_of: Column, hours: int = 24) -> Column:
    """missing, stale or fresh; a time in the future is fresh."""
    return F.when(at.isNull(), "missing").when(F.timestamp_diff("MICROSECOND", at, as_of) / F.lit(3.6e9) > hours, "stale").otherwise("fresh")


def read_regime_export(spark: SparkSession, folder: str | None, as_of: str, source: str = "regime_stream") -> Source:
    """One regime change from the export, or from the older snapshot where there is no export; unverified or stale ones
    keep a score of zero."""
    paths = [p for p in (f"{folder}/regime_export.json", f"{folder}/result_snapshot.json") if folder and exists(spark, p)]
    if not paths:
        return nothing(spark)
    read = _small(spark, paths[0]).withColumn("r", F.when(F.col("ok"), F.from_json("value", EXPORT)))
    regime = F.coalesce(label(F.col("r.market_regime")), F.lit("UNKNOWN"))
    regime = F.when(regime.isin(*EXPORT_REGIMES), regime).otherwise("UNKNOWN")
    at = F.coalesce("r.produced_at", "r.generated_at").try_cast("timestamp")
    verified = F.coalesce(F.col("r.data_is_real"), F.lit(False)) & (freshness(at, F.lit(as_of).cast("timestamp")) == "fresh")
    confidence = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(finite(F.col("r.confidence")).cast("int"), F.lit(0))))
    events = _shaped(
        read.where("r is not null"), seq=F.lit(0), event_id=F.sha2("value", 256), ts=at, source_bot=F.lit(source), event_type=F.lit(REGIME_CHANGE),
        strategy_id=F.concat(F.lit("regime_"), F.lower(regime)), regime=mapped(regime, EXPORT_REGIMES, F.lit("UNKNOWN")), score=F.when(verified, F.round(confidence / 100, 4)).otherwise(0.0),
        data_is_real=F.col("r.data_is_real"), metadata=F.to_json("r"),
    )
    return Source(events, _failed(read.where("r is null"), "not a readable export"))


# ---- datasets of bars, signals and outcomes

BAR = "struct<date string, open double, high double, low double, close double, volume bigint>"
DATASET = (
    f"symbol string, bars array<{BAR}>, signals array<struct<signal_date string, symbol string, direction string, setup_type string>>, "
    "outcomes array<struct<date string, setup_label string, setup_type string, win boolean, outcome string, return_pct double, pnl_pct double, data_is_real boolean>>"
)


def read_dataset(spark: SparkSession, path: str | list[str]) -> dict[str, DataFrame]:
    """bars, signals and outcomes of JSON datasets, in the shape the bar and outcome operators take."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", DATASET).alias("d"), F.col("_metadata.file_path").alias("file"))
    symbol = F.coalesce("d.symbol", F.lit(""))
    bars = whole.select(symbol.alias("symbol"), F.posexplode("d.bars").alias("row_id", "b"))
    signals = whole.select(symbol.alias("own"), "file", F.posexplode("d.signals").alias("n", "s"))
    outcomes = whole.select(F.posexplode("d.outcomes").alias("n", "o"))
    named = F.coalesce("o.setup_label", "o.setup_type", F.lit(""))
    return {
        "bars": bars.select("row_id", "symbol", F.col("b.date").try_cast("date").alias("date"), "b.open", "b.high", "b.low", "b.close", "b.volume"),
        "signals": signals.select(
            F.concat_ws("#", "file", F.col("n").cast("string")).alias("signal_id"), F.coalesce("s.symbol", "own").alias("symbol"), F.col("s.signal_date").try_cast("date").alias("signal_date"),
            F.col("s.direction").alias("direction"), F.col("s.setup_type").alias("setup_type"),
        ),
        "outcomes": outcomes.select(
            F.col("n").cast("bigint").alias("seq"), F.col("o.date").try_cast("date").alias("date"), named.alias("setup_label"), F.coalesce("o.outcome", F.when(F.col("o.win"), "WIN").when(~F.col("o.win"), "LOSS"), F.lit("")).alias("outcome"),
            finite(F.coalesce("o.return_pct", "o.pnl_pct")).alias("return_pct"), F.coalesce("o.data_is_real", F.lit(False)).alias("data_is_real"), F.col("o.win").alias("win"),
        ),
    }


def read_event_fixture(spark: SparkSession, path: str) -> DataFrame:
    """Events of one JSON fixture, a list or {"events": [...]}; raises on anything else."""
    rows, errors = _json_files(spark, [path])
    if errors.count():
        raise ValueError(f"not an event fixture: {path}")
    return generic_events(rows).withColumn("source_bot", F.coalesce(F.get_json_object("metadata", "$.source_bot"), "source_bot"))

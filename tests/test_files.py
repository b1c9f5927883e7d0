import json

import pytest

from outcomelens import cli
from outcomelens.sources import files, synthetic
from pyspark.sql import functions as F


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else json.dumps(text))


def test_generic_folder(spark, tmp_path):
    put(tmp_path / "a.json", {"trades": [{"strategy": "s1", "pnl": 5, "result": "win", "symbol": "x", "note": {"k": [1]}}, {"tactic": "s2", "realized_pnl": 0, "profit_loss": 7}]})
    put(tmp_path / "b.json", [{"type": "rejection", "score": 0.4, "strategy_id": "s3"}, {"type": "odd", "trade_type": "s4", "score": "NaN"}])
    put(tmp_path / "bad.json", "{nope")
    put(tmp_path / "one.json", {"strategy": "s5", "confidence": 2.0})
    put(tmp_path / "c.csv", "strategy,pnl,result\ns6,0,loss\ns7,-3.5,loss\n")
    put(tmp_path / "d.log", 'noise\n{"strategy": "s8", "pnl": 1}\n{broken\n')
    found = files.read_generic(spark, str(tmp_path))
    rows = {r.strategy_id: r for r in found.events.collect()}
    assert set(rows) == {f"s{k}" for k in range(1, 9)}
    assert rows["s1"].pnl == 5.0 and rows["s1"].outcome == "WIN" and rows["s1"].symbol == "X" and json.loads(rows["s1"].metadata)["note"]
    assert rows["s2"].pnl == 7.0 and rows["s6"].pnl == 0.0 and rows["s3"].event_type == "REJECTION" and rows["s4"].event_type == "TRADE_OUTCOME" and rows["s4"].score is None
    assert found.errors.count() == 2
    valid, rejected = files.quarantine(found.events)
    assert valid.count() == 7 and rejected.first().invalid == "score_out_of_range"


def test_absent_places(spark, tmp_path):
    for found in (files.read_generic(spark, None), files.read_options(spark, str(tmp_path / "no")), files.read_trades(spark, str(tmp_path / "no")), files.read_worker_snapshot(spark, None), files.read_regime_export(spark, None, "2026-01-01")):
        assert not found.present and found.events.count() == 0 and found.errors.count() == 0


def options(folder):
    audit = [
        dict(signal_id="g1", strategy_id="p", final_decision="ACCEPTED", regime="SIDEWAYS", score=0.8, symbol="a", risk_reward_result=dict(is_valid=True, risk_reward_ratio=1.5)),
        dict(signal_id="g2", strategy_id="p", final_decision="ACCEPTED", regime="ODD", risk_reward_result=None),
        dict(signal_id="g3", strategy_id="q", final_decision="skipped"), dict(signal_id="g4", strategy_id="", final_decision="ACCEPTED"),
    ]
    put(folder / files.AUDIT_FILE, "\n".join(map(json.dumps, audit)) + "\nnot json\n")
    put(folder / files.ACCURACY_FILE, {"recommendations": [dict(signal_id="g1", outcome_pnl=-1.0, outcome_win=False), dict(signal_id="g1", outcome_pnl=138.35, outcome_win=True), dict(signal_id="", outcome_pnl=1.0)]})
    chain = [dict(decision="reject", option_contract="c1", symbol="A"), dict(decision="REJECT", option_contract="c1", symbol="B"), dict(decision="ok", option_contract="c2")]
    put(folder / files.CHAIN_FILE, "\n".join(map(json.dumps, chain)))


def test_options_folder(spark, tmp_path):
    options(tmp_path)
    found = files.read_options(spark, str(tmp_path))
    rows = {r.event_id: r for r in found.events.collect()}
    assert set(rows) == {"audit:g1", "audit:g2", "audit:g3", "chain:c1"}
    one, two, three = (rows[f"audit:g{k}"] for k in (1, 2, 3))
    assert (one.event_type, one.pnl, one.outcome, one.regime, one.expected_rr) == ("TRADE_OUTCOME", 138.35, "WIN", "NORMAL", 1.5)
    assert (two.event_type, two.outcome, two.regime, two.expected_rr) == ("RECOMMENDATION", "PENDING", None, None)
    assert three.event_type == "REJECTION" and rows["chain:c1"].strategy_id == "chain_filter_A"
    assert found.errors.count() == 1


def test_trade_log_keeps_the_last_line_of_a_trade(spark, tmp_path):
    line = lambda **d: json.dumps(dict(event_type="SELL_EXECUTED", timestamp="2026-01-01 10:00:00", data=d))
    put(tmp_path / "t.jsonl", "\n".join([line(trade_id="1", exec_ids="a", netto_pnl="4", strategy="s", execution_mode="live"), line(trade_id="1", exec_ids="a", netto_pnl="5", strategy="s", execution_mode="live"),
                                         line(netto_pnl="inf", pnl_abs="-2"), line(netto_pnl="x"), json.dumps(dict(event_type="BUY")), "oops"]))
    found = files.read_trades(spark, str(tmp_path / "t.jsonl"))
    rows = sorted((r.pnl is None, r.pnl or 0, r.outcome, r.strategy_id, r.data_is_real) for r in found.events.collect())
    assert rows == [(False, -2.0, "LOSS", "UNKNOWN", False), (False, 5.0, "WIN", "s", True), (True, 0, "PENDING", "UNKNOWN", False)]
    assert found.errors.count() == 1


def test_snapshots(spark, tmp_path):
    put(tmp_path / "w.json", dict(worker_entrypoint_status="ok", completed_at="2026-01-01T00:00:00"))
    assert files.read_worker_snapshot(spark, str(tmp_path / "w.json")).events.first().score == 1.0
    put(tmp_path / "r" / "result_snapshot.json", dict(market_regime="risk_on", confidence=140, data_is_real=True, produced_at="2026-01-01T00:00:00"))
    fresh = files.read_regime_export(spark, str(tmp_path / "r"), "2026-01-01 12:00:00").events.first()
    assert (fresh.regime, fresh.score, fresh.strategy_id) == ("BULL", 1.0, "regime_risk_on")
    assert files.read_regime_export(spark, str(tmp_path / "r"), "2026-01-03 12:00:00").events.first().score == 0.0
    put(tmp_path / "r" / "regime_export.json", "x" * 70_000)
    found = files.read_regime_export(spark, str(tmp_path / "r"), "2026-01-01")
    assert found.events.count() == 0 and found.errors.count() == 1


def dataset(path):
    bars = [dict(date=f"2024-01-0{k + 1}", open=100 + k, high=103 + k, low=99 + k, close=102 + k, volume=10) for k in range(6)]
    put(path, dict(symbol="S", bars=bars, signals=[dict(signal_date="2024-01-01", symbol="S", direction="long", setup_type="breakout")], outcomes=[dict(date="2024-01-01", setup_type="odd", win=True)]))


def test_dataset_and_command_line(spark, tmp_path, capsys):
    dataset(tmp_path / "d.json")
    data = files.read_dataset(spark, str(tmp_path / "d.json"))
    assert data["bars"].count() == 6 and data["signals"].first().setup_type == "breakout" and data["outcomes"].first().outcome == "WIN"
    assert cli.main(["backtest", str(tmp_path / "d.json"), "--holding-days", "2"]) == 0
    assert "holding_period" in capsys.readouterr().out
    assert cli.main(["scan", str(tmp_path / "d.json")]) == 0 and cli.main(["outcomes", str(tmp_path / "d.json")]) == 0
    assert cli.main(["scan", str(tmp_path / "none.json")]) == 2 and cli.main(["verify-env"]) == 0
    capsys.readouterr()
    put(tmp_path / "e.json", {"events": [dict(strategy_id="s", outcome="WIN", realized_pnl=2.5, score=0.9)]})
    assert cli.main(["export-json", str(tmp_path / "e.json"), "--no-indent"]) == 0
    assert json.loads(capsys.readouterr().out)["analytics"]["Strategies"][0]["wins"] == 1
    put(tmp_path / "f.json", "{{")
    assert cli.main(["export-json", str(tmp_path / "f.json")]) == 2


def test_run_appends_its_artifacts(spark, tmp_path):
    from outcomelens.runner import run
    from outcomelens.sinks import tables

    options(tmp_path / "o")
    for _ in range(2):
        paths = run(spark, str(tmp_path / "out"), options=str(tmp_path / "o"))
    text = open(paths["report"]).read()
    assert "## Strategies" in text and "options_advisory" in text and "<table>" in open(paths["dashboard"]).read()
    envelope = json.load(open(paths["snapshot"]))
    assert envelope["payload"]["event_count"] == 4 and tables.conformance(envelope) == [] and envelope["data_is_real"] is False
    assert [r.run_count for r in tables.history(spark, paths["history"]).orderBy("run_count").collect()] == [1, 2]
    assert tables.runs_of(tables.read_all(spark, paths["baselines"])).count() == 2
    assert tables.conformance({}) != []


def test_rendering():
    from outcomelens.report import render

    table = render.Table("T", ["a|b", "c"], [("x|y", float("nan")), ("<i>", None), ("z" * 300, 1234.5)], True)
    text = render.markdown([table, render.Table("none", [], [])], "t")
    assert "x\\|y" in text and "…" in text and "more than 3 rows" in text and "none" not in text
    assert "&lt;i&gt;" in render.dashboard([table], "t")
    assert render.from_json(render.as_json([table], {}))[0].rows[0] == ("x|y", None)


def test_soak_study_is_repeatable(spark):
    from outcomelens.operators import backtest

    bars, signals = synthetic.inputs(spark, 12)
    ranked = backtest.setup_expectancy(backtest.backtest_trades(bars, signals)).orderBy("rank").collect()
    assert ranked[0].setup == "BREAKOUT" and ranked[0].trades == 12 and ranked[0].strength == "DIAGNOSTIC_ONLY"
    assert synthetic.walk("a", "b", 3, 0.1, 0.1, 1) == synthetic.walk("a", "b", 3, 0.1, 0.1, 1)


def test_unreadable_fixture(spark, tmp_path):
    put(tmp_path / "x.json", "?")
    with pytest.raises(ValueError):
        files.read_event_fixture(spark, str(tmp_path / "x.json"))


def test_options_assessment(spark, tmp_path):
    from datetime import datetime, timezone

    from outcomelens.gates import provenance

    at = datetime(2026, 1, 2, tzinfo=timezone.utc)
    assert provenance.assess_options(spark, None, at) == ["folder missing"]
    tmp_path.joinpath("o").mkdir()
    assert len(provenance.assess_options(spark, str(tmp_path / "o"), at)) == 2
    options(tmp_path / "o")
    assert provenance.assess_options(spark, str(tmp_path / "o"), at) == ["snapshot missing"]
    place = tmp_path / "o" / provenance.OPTIONS_SNAPSHOT
    for text, expected in (("{", ["snapshot unreadable"]), ([], ["snapshot is no object"]), (dict(broker_execution_enabled=False, data_is_real=True, produced_at="2026-01-01T00:00:00Z"), []),
                           (dict(broker_execution_enabled="no", data_is_real=1, produced_at="2025-12-01"), ["broker execution not declared off", "data not declared real", "older than allowed"])):
        put(place, text)
        assert provenance.assess_options(spark, str(tmp_path / "o"), at) == expected


def test_fit_correlation_and_soak_sections(spark, capsys):
    from outcomelens.plans import analytics
    from outcomelens.report import render, sections

    streams = analytics._all_real(spark, "/root/testdata/sf0.001")
    text = render.markdown(sections.fit_sections(streams) + sections.correlation_sections(streams, "stock", "options"), "t")
    assert "## Grid" in text and "## Rolling correlation" in text
    assert cli.main(["soak", "--signals", "8"]) == 0 and "BREAKOUT" in capsys.readouterr().out


def test_order_of_records_is_total_over_files_and_formats(spark, tmp_path):
    for k, name in enumerate(("b x.json", "a+1.json")):
        (tmp_path / name).write_text(json.dumps([{"strategy": f"j{k}{i}", "pnl": i + 1} for i in range(3)]))
    (tmp_path / "t.csv").write_text("strategy,pnl\nc0,1\nc1,2\n")
    (tmp_path / "u.csv").write_text("strategy,pnl,regime\nc2,1,BULL\n")
    (tmp_path / "v.log").write_text("noise\n" + "\n".join(json.dumps({"strategy": f"l{i}"}) for i in range(3)))
    rows = files.read_generic(spark, str(tmp_path)).events.collect()
    assert len({r.seq for r in rows}) == len(rows) == 12
    assert [r.strategy_id for r in sorted(rows, key=lambda r: r.seq)] == ["j10", "j11", "j12", "j00", "j01", "j02", "c0", "c1", "c2", "l0", "l1", "l2"]


def test_export_holds_every_row(spark, tmp_path, capsys):
    path = tmp_path / "events.json"
    path.write_text(json.dumps([{"event_type": "TRADE_OUTCOME", "strategy": f"s{k:03d}", "outcome": "WIN", "pnl": 1.0, "score": 0.5, "regime": "BULL"} for k in range(60)]))
    assert cli.main(["export-json", str(path)]) == 0
    found = json.loads(capsys.readouterr().out)["analytics"]
    assert len(found["Strategies"]) == len(found["Regime and strategy"]) == 60


def test_run_over_all_inputs(spark, tmp_path):
    from datetime import datetime, timezone

    from outcomelens.runner import run

    options(tmp_path / "o")
    put(tmp_path / "o" / "data/reports/strategy_performance.json", {"strategy": "x", "trades": 3})
    put(tmp_path / "t.jsonl", json.dumps({"event_type": "SELL_EXECUTED", "timestamp": "2026-01-01T10:00:00Z", "data": {"strategy": "t1", "trade_id": "a", "netto_pnl": "5", "ticker": "AB", "execution_mode": "LIVE"}}) + "\n")
    put(tmp_path / "g" / "a.json", [{"strategy": "g1", "pnl": 1, "outcome": "WIN"}])
    put(tmp_path / "w.json", {"status": "READY", "completed_at": "2026-01-01T00:00:00Z"})
    put(tmp_path / "r" / "regime_export.json", {"market_regime": "bull", "confidence": 80, "produced_at": "2026-01-01T20:00:00Z", "data_is_real": True})
    sources = dict(options=str(tmp_path / "o"), trades=str(tmp_path / "t.jsonl"), generic=str(tmp_path / "g"), worker=str(tmp_path / "w.json"), regime=str(tmp_path / "r"))
    for day in (2, 3):
        paths = run(spark, str(tmp_path / "out"), at=datetime(2026, 1, day, tzinfo=timezone.utc), **sources)
    text = open(paths["report"]).read()
    for title in ("Statistical floor", "Correlation", "Strategy performance", "Against earlier runs", "Diagnostics"):
        assert f"## {title}" in text, title
    assert "worker_health" in text and "regime_bull" in text and "sample_size_below_floor" in text and "| worker | given |" in text


def test_overrides_of_evidence(spark):
    from outcomelens.gates import floor

    events = spark.createDataFrame(
        [(k, "2026-01-01 00:00:00", "TRADE_OUTCOME", "s", "BULL", 0.9, None, 1.0, "WIN" if k % 5 else "LOSS", True) for k in range(40)],
        "seq bigint, ts string, event_type string, strategy_id string, regime string, score double, expected_rr double, pnl double, outcome string, data_is_real boolean",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    as_of = F.lit("2026-01-03").cast("timestamp")
    judge = lambda over=None: floor.statistical_floor(floor.evidence_from_events(events, over), as_of).first()
    assert judge().approved and judge().strength == "STRONG"
    over = spark.createDataFrame([("s", 0.001, "2026-01-02")], "strategy_id string, edge double, fresh_until string").withColumn("fresh_until", F.col("fresh_until").cast("timestamp"))
    assert judge(over).refusals == ["edge_below_floor", "evidence_stale"]

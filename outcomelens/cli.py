"""python -m outcomelens.cli run | backtest | scan | outcomes | export-json | soak | verify-env. Exit 0: done; 1: refused or no usable data; 2: unreadable input."""

from __future__ import annotations

import argparse
import importlib.util
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from outcomelens.operators.backtest import BacktestRules
from outcomelens.report import render, sections
from outcomelens.session import get_session, sweep
from outcomelens.sources import files

#: Packages that must not be importable where this tool runs (it only advises).
BANNED = ("ib_insync", "ibapi", "alpaca_trade_api", "ccxt")


def banned() -> list[str]:
    return [name for name in BANNED if importlib.util.find_spec(name)]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="outcomelens")
    commands = top.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run")
    for name in ("options", "trades", "generic", "worker", "regime"):
        run.add_argument(f"--{name}")
    run.add_argument("--out", default="reports")
    run.add_argument("--name", default="report")
    test = commands.add_parser("backtest")
    test.add_argument("dataset")
    test.add_argument("--holding-days", type=int, default=5)
    test.add_argument("--take-profit", type=float)
    test.add_argument("--stop-loss", type=float)
    commands.add_parser("scan").add_argument("dataset")
    result = commands.add_parser("outcomes")
    result.add_argument("dataset")
    result.add_argument("--min-sample", type=int, default=30)
    export = commands.add_parser("export-json")
    export.add_argument("dataset")
    export.add_argument("--no-indent", action="store_true")
    soak = commands.add_parser("soak")
    soak.add_argument("--signals", type=int, default=40)
    soak.add_argument("--seed", type=int, default=7)
    commands.add_parser("verify-env")
    return top


def main(arguments: list[str] | None = None) -> int:
    chosen = parser().parse_args(arguments)
    if found := banned():
        print(f"refused: {', '.join(found)} can be imported here", file=sys.stderr)
        return 1
    if chosen.command == "verify-env":
        print("ok")
        return 0
    if chosen.command not in ("run", "soak") and not Path(chosen.dataset).is_file():
        print(f"no such file: {chosen.dataset}", file=sys.stderr)
        return 2
    spark = get_session()
    try:
        return _run(chosen, spark)
    finally:
        sweep(spark)


def _run(chosen: argparse.Namespace, spark: SparkSession) -> int:
    """The exit code of a command that needs a session; the tables it cut are deleted after it."""
    if chosen.command == "run":
        from outcomelens.runner import run

        print(run(spark, chosen.out, chosen.name, options=chosen.options, trades=chosen.trades, generic=chosen.generic, worker=chosen.worker, regime=chosen.regime)["report"])
        return 0
    if chosen.command == "soak":
        from outcomelens.sources import synthetic

        print(render.markdown(sections.soak_sections(*synthetic.inputs(spark, chosen.signals, chosen.seed)), "soak"))
        return 0
    if chosen.command == "export-json":
        try:
            events = files.read_event_fixture(spark, chosen.dataset)
        except ValueError as error:
            print(error, file=sys.stderr)
            return 2
        with render.whole():
            shown = sections.event_sections(events)
        print(render.as_json(shown, {"source": chosen.dataset}, None if chosen.no_indent else 2))
        return 0
    data = files.read_dataset(spark, chosen.dataset)
    if chosen.command == "backtest":
        rules = BacktestRules(chosen.holding_days, chosen.take_profit, chosen.stop_loss)
        shown = sections.backtest_sections(data["bars"], data["signals"], rules)
    elif chosen.command == "scan":
        shown = sections.scan_sections(data["bars"])
    else:
        shown = sections.outcome_sections(data["outcomes"], chosen.min_sample)
    print(render.markdown(shown, chosen.command))
    return 0 if any(t.rows for t in shown if t.title != "Bar errors") else 1


if __name__ == "__main__":
    sys.exit(main())

"""Markdown, HTML and JSON renderings of result tables. What people read is cut to `most` rows and says how many there are;
an export (`most` None) holds every row."""

from __future__ import annotations

import html
import json
import math
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

MOST = 50


@dataclass
class Table:
    title: str
    columns: list[str]
    rows: list[tuple]
    more: int = 0  # rows that are not shown
    notes: list[str] = field(default_factory=list)


#: Whether fetch() brings every row: set by whole() for exports.
_WHOLE: ContextVar[bool] = ContextVar("whole", default=False)


@contextmanager
def whole() -> Iterator[None]:
    """Sections built inside hold every row: one a strategy, regime or symbol, as aggregates have them."""
    token = _WHOLE.set(True)
    try:
        yield
    finally:
        _WHOLE.reset(token)


def fetch(title: str, df: DataFrame, order: Iterable | None = None, most: int | None = MOST) -> Table:
    """The first `most` rows in the given order (a report of fixed length) and how many there are beyond; all of them if
    `most` is None or inside whole()."""
    ordered = df.orderBy(*order) if order else df
    if most is None or _WHOLE.get():
        return Table(title, df.columns, [tuple(r) for r in ordered.toLocalIterator()])
    rows = ordered.limit(most + 1).collect()
    return Table(title, df.columns, [tuple(r) for r in rows[:most]], df.count() - most if len(rows) > most else 0)


def shown(value: object) -> str:
    if value is None:
        return "-"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, float):
        return "-" if not math.isfinite(value) else f"{value:,.4g}" if abs(value) < 1 else f"{value:,.2f}"
    text = str(value)
    return text if len(text) <= 160 else text[:159] + "…"


def markdown(tables: list[Table], title: str, head: Iterable[str] = ()) -> str:
    lines = [f"# {title}", "", *head, ""]
    for table in tables:
        if not table.rows:
            continue
        lines += [f"## {table.title}", ""]
        cells = lambda row: "| " + " | ".join(shown(v).replace("|", "\\|").replace("\n", " ") for v in row) + " |"
        lines += [cells(table.columns), "|" + "---|" * len(table.columns), *map(cells, table.rows)]
        lines += ["", f"_more than {len(table.rows)} rows: {len(table.rows) + table.more} in all_"] if table.more else []
        lines += [*table.notes, ""]
    return "\n".join(lines).rstrip() + "\n"


def dashboard(tables: list[Table], title: str) -> str:
    """One self-contained page; everything is escaped."""
    e = lambda v: html.escape(shown(v))
    parts = [f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>body{{font:14px sans-serif;margin:2em}}table{{border-collapse:collapse}}td,th{{border:1px solid #ccc;padding:2px 8px}}.yes{{background:#fdd}}</style></head><body><h1>{html.escape(title)}</h1>"]
    for table in tables:
        head = "".join(f"<th>{html.escape(c)}</th>" for c in table.columns)
        body = "".join("<tr>" + "".join(f"<td{' class=yes' if v is True else ''}>{e(v)}</td>" for v in row) + "</tr>" for row in table.rows)
        parts.append(f"<h2>{html.escape(table.title)}</h2><table><tr>{head}</tr>{body}</table>")
    return "".join(parts) + "</body></html>"


def as_json(tables: list[Table], meta: dict, indent: int | None = 2) -> str:
    """Sorted, ASCII; withheld values stay null, and so do non-finite ones."""
    safe = lambda v: None if isinstance(v, float) and not math.isfinite(v) else v if isinstance(v, (int, float, bool, str, type(None))) else str(v)
    body = {t.title: [dict(zip(t.columns, map(safe, row))) for row in t.rows] for t in tables}
    return json.dumps({"meta": meta, "analytics": body}, sort_keys=True, ensure_ascii=True, indent=indent)


def from_json(text: str) -> list[Table]:
    """A rendered report read back, with safe defaults for what is missing."""
    analytics = json.loads(text).get("analytics") or {}
    return [Table(title, list(rows[0]) if rows else [], [tuple(r.values()) for r in rows]) for title, rows in analytics.items()]

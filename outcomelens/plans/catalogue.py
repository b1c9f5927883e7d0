"""All queries of the core, by name."""

from __future__ import annotations

from outcomelens.plans import analytics, quality

MODULES = (analytics, quality)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}

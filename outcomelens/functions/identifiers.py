"""Identifiers that compare without blanks at the ends and without letter case."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space cut off at both ends, and texts that hold no identifier.
WHITE = " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"
PLACEHOLDERS = ("", "n/a", "null", "none", "-")
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def identifier(raw: Column) -> Column:
    """The comparable form of an identifier; null where there is none."""
    bare = F.lower(F.btrim(raw, F.lit(WHITE)))
    return F.when(bare.isin(*PLACEHOLDERS), None).otherwise(bare)


def identifier_sql(column: str) -> str:
    """The same for DuckDB."""
    white = " || ".join(f"chr({ord(c)})" for c in WHITE)
    bare = f"lower(trim({column}, {white}))"
    return f"case when {bare} in ({', '.join(repr(p) for p in PLACEHOLDERS)}) then null else {bare} end"

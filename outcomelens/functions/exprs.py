"""Column helpers: fail-closed numbers, ratios and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from outcomelens.functions.identifiers import WHITE
from outcomelens.schema import SETUPS


def finite(value: Column) -> Column:
    """A double that is a number; null for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def safe_double(text: Column) -> Column:
    """The finite number a text spells, else null."""
    bare = F.btrim(text, F.lit(WHITE))
    return finite(F.when(bare != "", bare.try_cast("double")))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; null where whole is zero or null."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def money(amount: Column) -> Column:
    """Sum of amounts in whole cents, exact and independent of order."""
    return F.coalesce(F.sum(amount.cast("decimal(28,2)")), F.lit(0)).cast("double")


def mean(value: Column) -> Column:
    """Average through an exact decimal sum, so that it does not depend on the order of the rows."""
    return F.round(ratio(F.sum(value.cast("decimal(28,9)")), F.count(value)), 6)


def r6(value: Column, digits: int = 6) -> Column:
    return F.round(value, digits)


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def label(raw: Column) -> Column:
    return F.upper(F.btrim(raw, F.lit(WHITE)))


def setup_label(raw: Column) -> Column:
    """Known setup labels; everything else is UNKNOWN."""
    return F.when(label(raw).isin(*SETUPS), label(raw)).otherwise("UNKNOWN")


def setup_recognised(raw: Column) -> Column:
    """Whether the label names a setup, or plainly names none (null, empty, UNKNOWN)."""
    return F.coalesce(label(raw), F.lit("")).isin(*SETUPS, "", "UNKNOWN")


def or_unknown(regime: Column) -> Column:
    return F.when(F.coalesce(regime, F.lit("")) == "", "UNKNOWN").otherwise(regime)


def mapped(raw: Column, table: dict[str, str], default: Column) -> Column:
    """Look a label up in a small fixed table."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, label(raw)), default)


def withhold(metric: Column, enough: Column) -> Column:
    """The metric where its sample is large enough, else null."""
    return F.when(enough, metric)

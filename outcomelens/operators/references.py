"""References to records that do not exist, from signed counts per key.

Both sides become change deltas on one time line per key: a target's appearance is +1 existence, its end -1, a reference +1
reference. The deltas are maintained to the state after each instant: how often the key is referenced and how many of its
targets exist. A key is orphaned at an instant if it has references and no existence; the references that arrive at such
an instant are the orphans.

Deltas of one instant are summed before the first shuffle. The running counts are a two-level prefix sum: inside (key,
minute) by a window, and over the minutes of a key by a second window on their totals. One key may hold any share of all
rows; no task gets more than a minute of it, or more totals than its calendar has minutes.

Nulls: a reference without key or instant is no case; an existence interval without key or start is ignored, one
whose end is not after its start is empty; a null end is never reached. Repeated references each count by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from outcomelens.functions.identifiers import identifier
from outcomelens.session import cut

BLOCK = "minute"


def intervals_to_deltas(intervals: DataFrame, key: Column, start: Column, end: Column) -> DataFrame:
    """(key, at, existence) from rows that exist from start (inclusive) to end (exclusive)."""
    rows = intervals.select(key.alias("key"), start.alias("start"), end.alias("end")).where(
        "key is not null and start is not null and (end is null or end > start)"
    )
    both = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("existence")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("existence")))
    return (
        rows.select("key", F.explode(both).alias("d"))
        .select("key", "d.at", "d.existence")
        .where("at is not null")
        .groupBy("key", "at")
        .agg(F.sum("existence").alias("existence"))
    )


def first_seen_deltas(rows: DataFrame, key: Column, at: Column) -> DataFrame:
    """(key, at, existence) of targets that exist from their earliest row on."""
    return (
        rows.select(key.alias("key"), at.alias("at"))
        .where("key is not null and at is not null")
        .groupBy("key")
        .agg(F.min("at").alias("at"))
        .select("key", "at", F.lit(1).cast("bigint").alias("existence"))
    )


def references(rows: DataFrame, tab: str, field: str, row_id: str = "row_id", at: str = "received_at") -> DataFrame:
    """(key, at, tab, field, row_id) of the rows that name a target."""
    return rows.select(
        identifier(F.col(field)).alias("key"), F.col(at).alias("at"), F.lit(tab).alias("tab"), F.lit(field).alias("field"), F.col(row_id).alias("row_id")
    ).where("key is not null and at is not null")


def changes(refs: DataFrame, deltas: DataFrame) -> DataFrame:
    """(key, at, refs, existence): the signed deltas of both sides, one row per key and instant, written once for all readers."""
    none = F.lit(0).cast("bigint")
    referenced = refs.select("key", "at", F.lit(1).cast("bigint").alias("refs"), none.alias("existence"))
    existing = deltas.select("key", "at", none.alias("refs"), F.col("existence").cast("bigint").alias("existence"))
    return cut(referenced.unionByName(existing).groupBy("key", "at").agg(F.sum("refs").alias("refs"), F.sum("existence").alias("existence")))


def states(deltas: DataFrame) -> DataFrame:
    """(key, at, arrived, refs, existing): the counts of a key after the deltas (key, at, refs, existence) of each of its instants."""
    rows = deltas.withColumn("block", F.date_trunc(BLOCK, "at"))
    inside = Window.partitionBy("key", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("key", "block").agg(F.sum("refs").alias("r"), F.sum("existence").alias("e"))
    before = totals.select("key", "block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("r", "e")])
    running = rows.select("key", "block", "at", F.col("refs").alias("arrived"), F.sum("refs").over(inside).alias("refs"), F.sum("existence").over(inside).alias("existing"))
    return running.join(before, ["key", "block"]).select("key", "at", "arrived", (F.col("refs") + F.col("r")).alias("refs"), (F.col("existing") + F.col("e")).alias("existing"))


def orphaned() -> Column:
    """Whether a state is that of an orphan: referenced, and nothing there."""
    return (F.col("refs") > 0) & (F.col("existing") <= 0)


def judged(refs: DataFrame, deltas: DataFrame) -> DataFrame:
    """Every reference with the counts of its key at its instant (deltas of that instant included)."""
    return refs.join(states(changes(refs, deltas)).where("arrived > 0"), ["key", "at"]).select("tab", "field", "row_id", "key", "at", "refs", "existing")


def orphans(refs: DataFrame, deltas: DataFrame) -> DataFrame:
    """The references without a target at their instant: tab, field, period (YYYY-MM), row_id."""
    found = states(changes(refs, deltas)).where((F.col("arrived") > 0) & orphaned())
    return refs.join(found.select("key", "at"), ["key", "at"], "left_semi").select("tab", "field", F.date_format("at", "yyyy-MM").alias("period"), "row_id")


def report(refs: DataFrame, deltas: DataFrame) -> DataFrame:
    """References and orphans per table, field and month."""
    return (
        judged(refs, deltas)
        .groupBy("tab", "field", F.date_format("at", "yyyy-MM").alias("period"))
        .agg(F.count("*").alias("reference_count"), F.count_if(orphaned()).alias("orphan_count"))
        .withColumn("orphan_share", F.round(F.col("orphan_count") / F.col("reference_count"), 6))
    )


def counts(refs: DataFrame, deltas: DataFrame) -> DataFrame:
    """State per key: summed reference and existence deltas (partial sums before the shuffle)."""
    return maintain(None, changes(refs, deltas).select("key", "refs", "existence"))


def maintain(state: DataFrame | None, changes: DataFrame) -> DataFrame:
    """New state from the old one and a batch of signed deltas (key, refs, existence); keys back at zero leave it."""
    rows = changes if state is None else state.unionByName(changes)
    return rows.groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("existence").alias("existence")).where("refs <> 0 or existence <> 0")


def current_orphans(state: DataFrame) -> DataFrame:
    """Keys that are referenced now and do not exist now."""
    return state.where("refs > 0 and existence <= 0").select("key", "refs")

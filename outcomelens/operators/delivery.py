"""Messages delivered more than once: exactly one row of each identifier stays, the one that arrived first.

Identifiers of the form letters-digits[-digits...] are read as (producer, sequence number); per producer a set of
disjoint seen ranges is kept, a number is accepted once if no range covers it, and touching ranges merge. The widths of
the digit groups belong to the producer, so that the pair stands for exactly one identifier. Every other identifier is
resolved by an exact keyed lookup.

Hot identifiers: the range pass runs twice, first over (producer, block, salt) and then over what the first pass
accepted, so that copies of one number are spread over SALTS tasks. The keyed lookup finds the row that stays by an
aggregate that sums up before its shuffle; of the join back only the side of all rows can be hot, which adaptive execution
splits (spark.sql.adaptive.skewJoin, on by default).

Nulls, blanks and placeholders hold no identifier: such rows always stay. Ties cannot occur, as row_id is unique;
should it repeat, all rows with the lowest one stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from outcomelens.functions.identifiers import UUID, identifier

SEQUENCE = r"^([a-z]+)((?:-[0-9]{1,9}){1,3})$"
BLOCK_BITS = 12
SALTS = 16


class SeenRanges:
    """Disjoint, sorted, inclusive ranges of accepted numbers."""

    def __init__(self, low: np.ndarray | None = None, high: np.ndarray | None = None) -> None:
        self.low = np.empty(0, np.int64) if low is None else np.asarray(low, np.int64)
        self.high = np.empty(0, np.int64) if high is None else np.asarray(high, np.int64)

    def covered(self, numbers: np.ndarray) -> np.ndarray:
        if not len(self.low):
            return np.zeros(len(numbers), bool)
        at = np.searchsorted(self.low, numbers, side="right") - 1
        return (at >= 0) & (numbers <= self.high[np.maximum(at, 0)])

    def accept(self, numbers: np.ndarray) -> np.ndarray:
        """Mask of the numbers taken now: uncovered, and the first of its value in this batch; then they are merged in."""
        fresh = np.flatnonzero(~self.covered(numbers))
        values, first = np.unique(numbers[fresh], return_index=True)
        taken = np.zeros(len(numbers), bool)
        taken[fresh[first]] = True
        self.merge(values, values)
        return taken

    def merge(self, low: np.ndarray, high: np.ndarray) -> None:
        """Union with further ranges; ranges that overlap or touch become one."""
        if not len(low):
            return
        lows, highs = np.concatenate([self.low, low]), np.concatenate([self.high, high])
        order = np.argsort(lows, kind="stable")
        lows, highs = lows[order], np.maximum.accumulate(highs[order])
        opens = np.r_[True, lows[1:] > highs[:-1] + 1]
        self.low, self.high = lows[opens], highs[np.r_[np.flatnonzero(opens)[1:] - 1, len(lows) - 1]]


def parsed(rows: DataFrame, id_column: str, row_id: str = "row_id") -> DataFrame:
    """(row_id, id, producer, number); producer is null for malformed identifiers."""
    ident = F.col("id")
    digits = F.regexp_extract(ident, SEQUENCE, 2)
    widths = F.concat_ws(".", F.transform(F.split(F.substring(digits, 2, 99), "-"), F.length))
    number = F.regexp_replace(digits, "-", "")
    good = ident.rlike(SEQUENCE) & (F.length(number) <= 18)
    return (
        rows.select(F.col(row_id).alias("row_id"), identifier(F.col(id_column)).alias("id"))
        .where("id is not null")
        .withColumn("producer", F.when(good, F.concat_ws("/", F.regexp_extract(ident, SEQUENCE, 1), widths)))
        .withColumn("number", F.when(good, number.try_cast("bigint")))
    )


def _pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (producer, block, row_id). Adds surplus; rows that already are surplus pass. A row with `high`
    is no message but a range seen in earlier batches; its row_id is -1, so it comes before the messages of its block."""
    group, seen = None, SeenRanges()
    for batch in batches:
        if not batch.num_rows:
            continue
        producers, numbers = batch.column("producer"), batch.column("number").to_numpy()
        rows, surplus = batch.column("row_id").to_numpy(), batch.column("surplus").to_numpy(zero_copy_only=False).copy()
        highs = batch.column("high").fill_null(-1).to_numpy()
        coded = producers.dictionary_encode().indices.to_numpy()
        changes = (coded[1:] != coded[:-1]) | (numbers[1:] >> BLOCK_BITS != numbers[:-1] >> BLOCK_BITS)
        edges = np.r_[0, np.flatnonzero(changes) + 1, len(numbers)]
        for a, b in zip(edges[:-1], edges[1:]):
            here = (producers[int(a)].as_py(), int(numbers[a]) >> BLOCK_BITS)
            if here != group:
                group, seen = here, SeenRanges()
            known = a + np.flatnonzero(highs[a:b] >= 0)
            seen.merge(numbers[known], highs[known])
            new = a + np.flatnonzero((highs[a:b] < 0) & ~surplus[a:b])
            surplus[new] = ~seen.accept(numbers[new])
        out = [producers, batch.column("number"), batch.column("high"), batch.column("row_id"), pa.array(surplus)]
        yield pa.RecordBatch.from_arrays(out, ["producer", "number", "high", "row_id", "surplus"]).filter(pa.array((rows >= 0) | (highs < 0)))


def surplus_by_ranges(sequences: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """row_id of every surplus row among (producer, number, row_id); seen: ranges (producer, low, high) of earlier batches."""
    schema = "producer string, number bigint, high bigint, row_id bigint, surplus boolean"
    block, salt = F.shiftright("number", BLOCK_BITS), F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int")
    rows = sequences.select("producer", "number", F.lit(None).cast("bigint").alias("high"), "row_id", F.lit(False).alias("surplus"))
    spread = rows.repartition("producer", block, salt).sortWithinPartitions("producer", block, "row_id")
    once = spread.mapInArrow(_pass, schema)
    if seen is not None:
        once = once.unionByName(by_block(seen))
    home = once.repartition("producer", block, F.when(F.col("surplus"), salt).otherwise(-1)).sortWithinPartitions("producer", block, "row_id")
    return home.mapInArrow(_pass, schema).where("surplus").select("row_id")


def by_block(seen: DataFrame) -> DataFrame:
    """Ranges cut at block edges, as rows of the range pass."""
    blocks = seen.withColumn("block", F.explode(F.sequence(F.shiftright("low", BLOCK_BITS), F.shiftright("high", BLOCK_BITS))))
    first = F.shiftleft("block", BLOCK_BITS)
    return blocks.select(
        "producer",
        F.greatest("low", first).alias("number"),
        F.least("high", first + ((1 << BLOCK_BITS) - 1)).alias("high"),
        F.lit(-1).cast("bigint").alias("row_id"),
        F.lit(False).alias("surplus"),
    )


def exact_key(ident: Column) -> Column:
    """Half-size key: the 16 bytes of a UUID; other identifiers as their text with a mark that makes it longer than those."""
    packed = F.unhex(F.replace(ident, F.lit("-"), F.lit("")))
    return F.when(ident.rlike(UUID), packed).otherwise(F.encode(F.concat(F.lit("id:               "), ident), "UTF-8"))


def surplus_by_lookup(rows: DataFrame) -> DataFrame:
    """row_id of every surplus row among (id, row_id), by the exact key."""
    keyed = rows.select(exact_key(F.col("id")).alias("key"), "row_id")
    kept = keyed.groupBy("key").agg(F.min("row_id").alias("kept"), F.count("*").alias("copies")).where("copies > 1")
    return keyed.join(kept, "key").where("row_id <> kept").select("row_id")


def surplus_rows(rows: DataFrame, id_column: str, sequences: bool = True) -> DataFrame:
    """row_id of all rows of an identifier but the one with the lowest row_id.

    sequences: False if no identifier of this table is numbered by its producer; all go to the lookup, with the same rows."""
    ids = parsed(rows, id_column)
    if not sequences:
        return surplus_by_lookup(ids)
    return surplus_by_ranges(ids.where("producer is not null")).unionByName(surplus_by_lookup(ids.where("producer is null")))


def keyed(rows: DataFrame, id_column: str, columns: list[str] = [], row_id: str = "row_id") -> DataFrame:
    """key, row_id and the given columns; a row without identifier is its own key."""
    key = F.coalesce(exact_key(identifier(F.col(id_column))), F.encode(F.concat(F.lit("row:"), F.col(row_id).cast("string")), "UTF-8"))
    return rows.select(key.alias("key"), F.col(row_id), *columns)


def first_deliveries(rows: DataFrame, id_column: str, columns: list[str], row_id: str = "row_id", prunable: bool = False) -> DataFrame:
    """One row per identifier (lowest row_id) with the given columns; rows without identifier all stay.

    Aggregated before the shuffle, so an identifier may hold any share of the rows. Adds key and copies. The columns
    travel as one struct, or, if prunable, each by itself, so that those a query does not use are never read."""
    groups = keyed(rows, id_column, columns, row_id).groupBy("key")
    copies = F.count("*").alias("copies")
    if prunable:
        return groups.agg(copies, F.min(row_id).alias("row_id"), *[F.min_by(c, row_id).alias(c) for c in columns])
    best = F.min(F.struct(F.col(row_id).alias("row_id"), *columns)).alias("best")
    return groups.agg(best, copies).select("key", "copies", "best.*")


def ranges(sequences: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The state after a batch: disjoint seen ranges (producer, low, high), touching ones merged.

    Ranges are built inside each block of numbers; only those that reach an edge of their block (two a block at most)
    meet again in one window per producer."""
    block = F.shiftright("low", BLOCK_BITS).alias("block")
    parts = sequences.select("producer", F.col("number").alias("low"), F.col("number").alias("high")).distinct()
    if seen is not None:
        parts = parts.unionByName(by_block(seen).select("producer", F.col("number").alias("low"), "high"))
    inside = _merged(parts.select("producer", block, "low", "high"), ["producer", "block"])
    first = F.shiftleft("block", BLOCK_BITS)
    edge = (F.col("low") == first) | (F.col("high") == first + ((1 << BLOCK_BITS) - 1))
    across = _merged(inside.where(edge).select("producer", "low", "high"), ["producer"])
    return inside.where(~edge).select("producer", "low", "high").unionByName(across)


def _merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("low", "high")
    before = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = parts.withColumn("opens", F.when(before.isNull() | (F.col("low") > before + 1), 1).otherwise(0))
    return (
        opened.withColumn("part", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "part")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .drop("part")
    )

"""Runs of equal consecutive values in long series (gaps and islands), without ever sorting a whole series in one task.

Rows are (field, series, block, at, row_id, value), where the blocks of a series follow each other in time. Runs are found
inside the blocks; those that touch an edge of their block (two a block at most) are joined across blocks by a second
pass. The result does not depend on how a series is cut into blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def islands(readings: DataFrame) -> DataFrame:
    """(field, series, block, at, row_id, value) with `opens` and the number of the run of equal values inside the block."""
    order = Window.partitionBy("field", "series", "block").orderBy("at", "row_id")
    opens = F.coalesce(F.lag("value").over(order) != F.col("value"), F.lit(True))
    marked = readings.withColumn("opens", opens)
    return marked.withColumn("island", F.sum(F.when(F.col("opens"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def runs(marked: DataFrame) -> DataFrame:
    """The islands with `run`, the length of the whole run across blocks, and `goes_on`: it began in an earlier block."""
    here, whole = ["field", "series", "block"], Window.partitionBy("field", "series", "block")
    parts = (
        marked.groupBy(*here, "island")
        .agg(F.min("value").alias("value"), F.count("*").alias("length"))
        .withColumn("inner", (F.col("island") > 1) & (F.col("island") < F.max("island").over(whole)))
    )
    # only runs that touch an edge of their block may go on in the next one
    along = Window.partitionBy("field", "series").orderBy("block", "island")
    goes_on = F.coalesce((F.lag("value").over(along) == F.col("value")) & (F.lag("block").over(along) != F.col("block")), F.lit(False))
    edges = parts.where("not inner").withColumn("goes_on", goes_on)
    edges = edges.withColumn("chain", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edges.select(*here, "island", "value", "goes_on", F.sum("length").over(Window.partitionBy("field", "series", "chain")).alias("run"))
    return parts.where("inner").select(*here, "island", "value", F.lit(False).alias("goes_on"), F.col("length").alias("run")).unionByName(joined)


def longest(rows: DataFrame, states: dict[str, str]) -> DataFrame:
    """(field, series) with the longest run of each of the given values, 0 where there is none."""
    found = [F.coalesce(F.max(F.when(F.col("value") == value, F.col("run"))), F.lit(0)).alias(name) for value, name in states.items()]
    return runs(islands(rows)).groupBy("field", "series").agg(*found)


def as_series(rows: DataFrame, series: Column, at: Column, block: Column, row_id: Column, value: Column) -> DataFrame:
    columns = [c.alias(n) for c, n in ((F.lit(""), "field"), (series, "series"), (block, "block"), (at, "at"), (row_id, "row_id"), (value, "value"))]
    return rows.select(*columns)

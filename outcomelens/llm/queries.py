"""Queries p6 to p8 over the whole corpus, and the SQL of what can be told in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from outcomelens.llm import encoding, leakage, repetition
from outcomelens.sources.tables import table


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents").select("doc_id", "text"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    return encoding.decode(p6_ids(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(table(spark, d, "documents")).select("doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p6_ids, p6_decoded, p7_found, p8_found, p8_shares)}

SQL: dict[str, str] = {"p6_decoded": "select doc_id, coalesce(text, '') as text from documents"}

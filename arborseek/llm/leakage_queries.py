"""Queries of the leakage operator. SQL can't express what a reader sees; tests compare with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborseek.llm import leakage as ops
from arborseek.sources.tables import table


def p7_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Every leaked item with the place of a leaked passage."""
    return ops.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_passages(spark, folder).select("doc_id", "item_id").distinct()


QUERIES = {"p7_found": p7_found, "p7_passages": p7_passages}
SQL: dict[str, str] = {}

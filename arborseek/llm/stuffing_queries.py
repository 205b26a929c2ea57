"""Queries of the stuffing operator. SQL can't express the reading of lines; tests use made pages of each kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborseek.llm import stuffing as ops
from arborseek.sources.tables import table


def p8_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Spam pages with the number of their words and of those that are evidence."""
    return ops.spam_pages(table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_pages(spark, folder).select("doc_id")


QUERIES = {"p8_found": p8_found, "p8_pages": p8_pages}
SQL: dict[str, str] = {}

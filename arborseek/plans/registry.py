"""All queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborseek.plans import catalog, changes, context, retrieval

MODULES = (changes, retrieval, context, catalog)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["search"](spark, folder)

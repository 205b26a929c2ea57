"""Readers of the parquet tables an index folder holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of ``folder``; columns are pruned and filters pushed down by the parquet scan."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")

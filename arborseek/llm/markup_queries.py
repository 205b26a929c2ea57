"""Queries of the markup operator. SQL can't express the reading; tests use made texts of each form and look-alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborseek.llm import markup as ops
from arborseek.sources.tables import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each family of markup in a current row's body or hierarchy."""
    read = ops.read(table(spark, folder, "chunks"))
    fields = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"{f}_families").alias("families")) for f in ("body", "hierarchy")))
    return read.select("id", F.inline(fields)).select("id", "field_name", F.explode("families").alias("family"))


def p5_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Every current row with its clean texts and the families found."""
    return ops.read(table(spark, folder, "chunks"), with_text=True)


QUERIES = {"p5_found": p5_found, "p5_clean": p5_clean}
SQL: dict[str, str] = {}

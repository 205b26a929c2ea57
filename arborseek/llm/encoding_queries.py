"""Queries of the encoding operator. SQL can't encode, but it tells whether the ids give the texts back; tests compare with a second library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborseek.llm import encoding as ops
from arborseek.sources.tables import table


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return ops.encode_documents(table(spark, folder, "documents"), ops.read_vocabulary())


def p6_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The MD5 of every text as its ids give it back; null texts come back empty."""
    return ops.decode_documents(p6_ids(spark, folder), ops.read_vocabulary()).select("doc_id", F.md5("text").alias("text_md5"))


QUERIES = {"p6_ids": p6_ids, "p6_round_trip": p6_round_trip}
SQL = {"p6_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents"}

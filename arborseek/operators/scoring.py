"""Scores: BM25, context IDF, heading and locality boosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
HEADING_MAX, HEADING_DECAY, LOCAL_BOOST = 5.0, 0.7, 1.5


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bm25_idf(df: Column | str, count: int | Column) -> Column:
    n = F.lit(count) if isinstance(count, int) else count
    return F.ln(1 + (n - _col(df) + 0.5) / (_col(df) + 0.5))


def bm25(tf: Column | str, length: Column | str, avg: Column | str, idf: Column) -> Column:
    return idf * (K1 + 1) * _col(tf) / (_col(tf) + K1 * (1 - B + B * _col(length) / _col(avg)))


def context_idf(df: Column | str, count: int | Column) -> Column:
    """``ln((N + 1) / (df + 1)) + 1``; null for a term no chunk holds."""
    n = F.lit(count) if isinstance(count, int) else count
    return F.when(_col(df) > 0, F.ln((n + 1) / (_col(df) + 1)) + 1)


def heading_boost(depth: Column | str, most: float = HEADING_MAX, decay: float = HEADING_DECAY) -> Column:
    """The most for documents and first headings, less by the decay for each level below."""
    return F.when(_col(depth) <= 1, F.lit(most)).otherwise(F.lit(most) * F.pow(F.lit(decay), _col(depth) - 1))


def locality_boost(rows: DataFrame, trees: DataFrame, boost: float = LOCAL_BOOST) -> DataFrame:
    """Adds ``locality``: the boost for local trees and unknown ones, 1 for global trees."""
    known = trees.where("name is not null").groupBy(F.col("name").alias("__name")).agg(F.max("is_global").alias("__global"))
    joined = rows.join(known, F.col("tree") == F.col("__name"), "left")
    return joined.withColumn("locality", F.when(F.coalesce("__global", F.lit(False)), 1.0).otherwise(F.lit(boost))).drop("__name", "__global")

"""Queries of the splitting operator and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborseek.llm import splitting as ops
from arborseek.llm.sql import CURRENT
from arborseek.sources.tables import table


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of all oversized bodies, in order."""
    return ops.split(ops.oversized(table(spark, folder, "chunks"), table(spark, folder, "settings")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The bodies that were cut: each has exactly one second piece."""
    return p4_pieces(spark, folder).where("piece = 1").select("id")


def p4_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Of each cut body what its pieces, put together without their overlaps, give, and whether all keep the limits."""
    rows = ops.oversized(table(spark, folder, "chunks"), table(spark, folder, "settings"))
    shared = F.least("overlap", F.col("size") - 1)
    each = ops.split(rows).join(rows.select("id", "size", shared.alias("shared")), "id")
    own = F.when(F.col("piece") == 0, F.col("text")).otherwise(F.substring("text", F.col("shared") + 1, F.char_length("text")))
    parts = F.array_sort(F.collect_list(F.struct("piece", "start", "end", own.alias("own"))))
    whole = each.groupBy("id", "shared").agg(parts.alias("parts"), F.min(F.char_length("text") <= F.col("size")).alias("within_limit"))
    meets = F.forall(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.get("parts", i)["start"] == F.get("parts", i - 1)["end"] - F.col("shared"))
    text = F.array_join(F.transform("parts", lambda p: p["own"]), "")
    return whole.select("id", F.md5(text).alias("text_md5"), F.char_length(text).alias("chars"), "within_limit", meets.alias("overlaps_exact"))


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces, "p4_cover": p4_cover}

_LONG = (
    CURRENT
    + """, sizes AS (SELECT tree, arg_min(max_chunk_size, layer) FILTER (max_chunk_size > 0) AS size FROM settings WHERE layer IS NOT NULL GROUP BY tree)
SELECT {columns} FROM cur LEFT JOIN sizes USING (tree) WHERE length(body) > coalesce(size, 50000)"""
)
SQL = {
    "p4_found": _LONG.replace("{columns}", "id"),
    "p4_cover": _LONG.replace("{columns}", "id, md5(body) AS text_md5, length(body) AS chars, true AS within_limit, true AS overlaps_exact"),
}

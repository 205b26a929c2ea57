"""The current row of every id of a chunk table that also holds copies and older versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborseek.session import written

REPEATED = 200_000  # ids that are broadcast at most, about 10 MB


def repeated_ids(chunks: DataFrame) -> DataFrame:
    """``(id)`` of the ids with several rows, as a written table: a count over one column."""
    return written(chunks.where(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated-ids")


def newest_rows(chunks: DataFrame, *columns: Column | str, tie: tuple[str, ...] = ("body", "tags", "hierarchy")) -> DataFrame:
    """What :func:`current_rows` gives, for rows that are costly to read twice: all cross the network.

    The maximum is taken before the shuffle too, so an id that holds a third of all rows leaves at most one
    row per input partition, and each row crosses the network once with just the columns asked for.
    """
    wanted = [F.col(c) if isinstance(c, str) else c for c in columns]
    row = F.struct(F.col("mtime").alias("__mtime"), F.xxhash64(*tie).alias("__tie"), *wanted)
    best = chunks.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(row).alias("__row"))
    return best.select("id", "__row.*").drop("__mtime", "__tie")


def current_rows(chunks: DataFrame, *columns: Column | str, tie: tuple[str, ...] = ("body", "tags", "hierarchy")) -> DataFrame:
    """One row ``(id, *columns)`` per id: that with the greatest mtime, a null mtime being the smallest.

    Exact copies count once. Of different rows with equal id and mtime the one with the greatest hash of the
    ``tie`` columns is taken, so reruns agree. Rows without an id have no identity and are left out; an empty
    table gives an empty table. ``columns`` may be expressions over the row; name them apart from ``id``.

    An id that stands once is current where it lies. So only ids are shuffled, to count them, and the rows of those
    that stand several times; these ids are broadcast, up to ``REPEATED`` of them. Where more stand several times, all
    rows are shuffled instead.
    """
    wanted = [F.col(c) if isinstance(c, str) else c for c in columns]
    repeated = repeated_ids(chunks)
    if repeated.limit(REPEATED + 1).count() > REPEATED:
        return newest_rows(chunks, *columns, tie=tie)
    few = F.broadcast(repeated)
    sole = chunks.where(F.col("id").isNotNull()).join(few, "id", "left_anti").select("id", *wanted)
    return sole.unionByName(newest_rows(chunks.join(few, "id", "left_semi"), *columns, tie=tie))

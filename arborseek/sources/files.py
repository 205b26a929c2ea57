"""Discovery of the files of trees, and spans of their bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborseek.config import BINARY, Tree, glob_regex


def plain_path(path: Column | str) -> Column:
    """A path without the scheme of local files."""
    return F.regexp_replace(path, "^file:/*", "/")


def discover(spark: SparkSession, trees: list[Tree]) -> DataFrame:
    """``(tree, path, abs_path, mtime, content)`` of the files of all trees: hidden and binary ones out, include and not exclude.

    Files are listed and read in parallel; ``content`` is only read where it is used.
    """
    made = None
    for t in trees:
        root = t.path.rstrip("/")
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        full = plain_path("path")
        rows = found.select(F.lit(t.name).alias("tree"), F.substring(full, len(root) + 2, 1 << 20).alias("path"), full.alias("abs_path"), F.col("modificationTime").alias("mtime"), "content")
        keep = ~F.col("path").rlike(r"(^|/)\.") & ~F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*BINARY)
        for patterns, wanted in ((t.include, True), (t.exclude, False)):
            if patterns:
                hit = F.col("path").rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))
                keep &= hit if wanted else ~hit
        part = rows.where(keep)
        made = part if made is None else made.unionByName(part)
    return made if made is not None else spark.createDataFrame([], "tree string, path string, abs_path string, mtime timestamp, content binary")


def read_spans(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``span``: the text between ``byte_start`` and ``byte_end`` of the row's file; null where the bounds lie outside."""
    content = files.select("tree", "path", "content")
    joined = rows.join(content, ["tree", "path"], "left")
    good = (F.col("byte_start") >= 0) & (F.col("byte_end") <= F.length("content")) & (F.col("byte_start") <= F.col("byte_end"))
    cut = F.decode(F.substring("content", (F.col("byte_start") + 1).cast("int"), (F.col("byte_end") - F.col("byte_start")).cast("int")), "UTF-8")
    return joined.withColumn("span", F.when(good, cut)).drop("content")

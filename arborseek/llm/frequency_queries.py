"""Queries of the frequency operator and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborseek.llm import frequency as ops
from arborseek.llm.sql import CURRENT
from arborseek.sources.tables import table


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every term and tag value with its occurrences and records, and the mark where it has one."""
    chunks = table(spark, folder, "chunks")
    marked = ops.verdicts(ops.ngram_counts(ops.chunk_records(chunks)), ops.current_total(chunks))
    return marked.select("field_name", F.col("ngram").alias("term"), "occurrences", "records", "verdict")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_counts(spark, folder).where("verdict is not null").select("field_name", "term", "verdict")


def p2_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Phrases of two and three terms of the bodies that at least three current rows hold."""
    records = ops.chunk_records(table(spark, folder, "chunks")).where("field_name = 'body'")
    kept = ops.ngram_counts(records, longest=3).where("n > 1 and records >= 3")
    return kept.select(F.translate("ngram", ops.SEP, " ").alias("ngram"), "n", "occurrences", "records")


QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts, "p2_ngrams": p2_ngrams}

_TERMS = (
    CURRENT
    + r""", found AS (
  SELECT id, 'body' AS field_name, unnest(list_filter(regexp_extract_all(lower(body), '[\p{L}\p{N}]+'), lambda t: strlen(t) < 40)) AS term FROM cur
  UNION ALL
  SELECT id, 'tags', unnest(list_filter(list_transform(tags, lambda t: regexp_replace(lower(t), '^\s+|\s+$', '', 'g')), lambda t: t <> '')) FROM cur
), counts AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM found GROUP BY ALL),
marked AS (SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records * 5 > (SELECT count(*) FROM cur) THEN 'common' END AS verdict FROM counts)
"""
)
SQL = {
    "p2_found": _TERMS + "SELECT field_name, term, verdict FROM marked WHERE verdict IS NOT NULL",
    "p2_counts": _TERMS + "SELECT field_name, term, occurrences, records, verdict FROM marked",
    "p2_ngrams": CURRENT
    + r""", docs AS (SELECT id, list_filter(regexp_extract_all(lower(body), '[\p{L}\p{N}]+'), lambda t: strlen(t) < 40) AS w FROM cur),
spots AS (SELECT id, w, unnest(range(1, len(w))) AS i FROM docs),
grams AS (SELECT id, 2 AS n, w[i] || ' ' || w[i + 1] AS ngram FROM spots UNION ALL SELECT id, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM spots WHERE i + 2 <= len(w))
SELECT ngram, n, count(*) AS occurrences, count(DISTINCT id) AS records FROM grams GROUP BY ngram, n HAVING count(DISTINCT id) >= 3""",
}

"""Queries of the distinctiveness operator and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborseek.llm import distinctive as ops
from arborseek.llm.sql import CURRENT
from arborseek.sources.tables import table


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, int]:
    chunks = table(spark, folder, "chunks")
    pairs = ops.term_counts(chunks)
    return pairs, ops.term_margins(pairs), ops.document_total(chunks)


def p3_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every term of every document with its score."""
    pairs, margins, documents = _tables(spark, folder)
    return ops.with_margins(pairs, margins, documents).select("doc_id", "term", ops.tf_idf(documents).alias("score"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The three most characteristic terms of each document among those that another document shares."""
    pairs, margins, documents = _tables(spark, folder)
    shared = ops.with_margins(pairs, margins.where("df >= 2"), documents)
    scored = shared.select("doc_id", "term", ops.tf_idf(documents).alias("score"))
    return ops.best(scored, 3).select("doc_id", "term")


def p3_residuals(spark: SparkSession, folder: str) -> DataFrame:
    """The five terms of each document with the largest correspondence-analysis residuals."""
    pairs, margins, documents = _tables(spark, folder)
    return ops.best(ops.residuals(pairs, margins, documents), 5)


QUERIES = {"p3_found": p3_found, "p3_scores": p3_scores, "p3_residuals": p3_residuals}

_PAIRS = (
    CURRENT
    + r""", tokens AS (
  SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(body), '[\p{L}\p{N}]+'), lambda t: strlen(t) < 40)) AS term FROM cur WHERE doc_id IS NOT NULL
), pairs AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
margins AS (SELECT term, count(*) AS df, sum(tf) AS occurrences FROM pairs GROUP BY term),
scored AS (SELECT doc_id, term, df, round(tf * ln(((SELECT count(DISTINCT doc_id) FROM chunks) + 1) / (df + 1)), 6) AS score FROM pairs JOIN margins USING (term))
"""
)
SQL = {
    "p3_scores": _PAIRS + "SELECT doc_id, term, score FROM scored",
    "p3_found": _PAIRS + "SELECT doc_id, term FROM scored WHERE df >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) <= 3",
    "p3_residuals": _PAIRS
    + """, totals AS (SELECT doc_id, sum(tf) AS r FROM pairs GROUP BY doc_id), grand AS (SELECT sum(tf)::DOUBLE AS n FROM pairs),
expected AS (SELECT doc_id, term, tf, r * occurrences / n AS e, (1 - r / n) * (1 - occurrences / n) AS v FROM pairs JOIN margins USING (term) JOIN totals USING (doc_id), grand),
res AS (SELECT doc_id, term, round(CASE WHEN e * v > 0 THEN (tf - e) / sqrt(e * v) ELSE 0 END, 6) AS score FROM expected)
SELECT doc_id, term, score FROM res QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) <= 5""",
}

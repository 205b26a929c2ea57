"""Queries of the change operator and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborseek.operators import changes as ops
from arborseek.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return ops.document_changes(table(spark, folder, "chunks"), table(spark, folder, "manifest"), table(spark, folder, "index_runs"))


QUERIES = {"p1_found": p1_found}

# dot segments and separators as the manifest spells them: "./x", "a//b", "a\b", "a/./b"; SQL has no fold for ".."
SQL = {
    "p1_found": r"""
WITH entries AS (
  SELECT tree || ':' || regexp_replace(regexp_replace(replace(path, '\', '/'), '(^|/)(\./)+', '\1', 'g'), '/+', '/', 'g') AS doc_id, run_id, op, date_trunc('second', mtime) AS mtime
  FROM manifest WHERE run_id IN (SELECT run_id FROM index_runs WHERE status = 'committed')
), last AS (
  SELECT doc_id, arg_max(op, run_id) AS op, arg_max(coalesce(mtime, TIMESTAMP '1900-01-01'), run_id) AS mtime FROM entries GROUP BY doc_id
), recorded AS (SELECT doc_id, mtime FROM last WHERE op = 'put'),
docs AS (SELECT doc_id, date_trunc('second', max(mtime)) AS mtime FROM chunks WHERE doc_id IS NOT NULL GROUP BY doc_id)
SELECT coalesce(d.doc_id, r.doc_id) AS doc_id, CASE WHEN r.doc_id IS NULL THEN 'added' WHEN d.doc_id IS NULL THEN 'removed' ELSE 'modified' END AS change_kind
FROM docs d FULL JOIN recorded r ON d.doc_id = r.doc_id
WHERE r.doc_id IS NULL OR d.doc_id IS NULL OR d.mtime IS DISTINCT FROM r.mtime
""",
}

"""Queries of listings, slugs, rules, settings and files, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborseek.chunking import chunk_documents
from arborseek.config import glob_regex
from arborseek.functions.text import breadcrumb, slug, title
from arborseek.operators import changes
from arborseek.operators import index as ix
from arborseek.plans.sql import CURRENT
from arborseek.sources.tables import table

RULES = {"markdown": "**/*.md", "notes": "notes/{2024,2025}/**", "api": "api/*", "text": "*.txt"}


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return ix.index_rows(table(spark, folder, "chunks"))


def doc_listing(spark, folder):
    found = _rows(spark, folder).groupBy("doc_id", "tree", "path")
    return found.agg(F.count("*").alias("chunks"), F.sum(F.octet_length("body")).alias("bytes"), F.min_by(title("hierarchy"), "id").alias("title"))


def chunk_listing(spark, folder):
    return _rows(spark, folder).select("id", "depth", breadcrumb("hierarchy").alias("breadcrumb"), F.octet_length("body").alias("bytes"))


def get_by_id(spark, folder):
    """The chunk with the greatest id."""
    rows = _rows(spark, folder)
    wanted = table(spark, folder, "chunks").agg(F.max("id")).first()[0]
    return rows.where(F.col("id") == wanted).select("id", "doc_id", "depth", "body")


def get_by_path(spark, folder):
    """All chunks of the document with the greatest id."""
    rows = _rows(spark, folder)
    wanted = table(spark, folder, "chunks").agg(F.max("doc_id")).first()[0]
    return rows.where(F.col("doc_id") == wanted).select("id", "position", title("hierarchy").alias("title")).orderBy("id")


def json_results(spark, folder):
    """Every chunk as one JSON object."""
    return _rows(spark, folder).select("id", F.to_json(F.struct("id", "doc_id", "depth")).alias("json"))


def slugify(spark, folder):
    return _rows(spark, folder).select("id", slug(title("hierarchy")).alias("slug"))


def slug_dedup(spark, folder):
    """Slugs of a document's headings in order, later ones of the same base numbered."""
    rows = _rows(spark, folder).where("depth > 0").select("id", "doc_id", "position", slug(title("hierarchy")).alias("base"))
    n = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("position", "id")) - 1
    return rows.select("id", F.when(n > 0, F.concat_ws("-", "base", n)).otherwise(F.col("base")).alias("slug"))


def id_parts(spark, folder):
    """Tree, path and slug of every chunk id."""
    rest = F.substring_index(F.substring(F.col("id"), F.instr("id", ":") + 1, F.lit(1 << 20)), "#", 1)
    return _rows(spark, folder).select("id", F.substring_index("id", ":", 1).alias("tree"), rest.alias("path"), F.when(F.col("id").contains("#"), F.substring_index("id", "#", -1)).alias("slug"))


def rule_match(spark, folder):
    """Which rules match each document's path."""
    docs = _rows(spark, folder).select("doc_id", "path").distinct()
    hits = [F.when(F.col("path").rlike(glob_regex(p)), n) for n, p in RULES.items()]
    return docs.select("doc_id", F.array_join(F.array_compact(F.array(*hits)), ",").alias("rules"))


def included_files(spark, folder):
    """Documents that their tree's patterns take in: included by any, excluded by none. Patterns are few, trees fixed."""
    trees = table(spark, folder, "trees").where("name is not null").select("name", "include_patterns", "exclude_patterns").distinct().collect()
    docs = _rows(spark, folder).select("doc_id", "tree", "path").distinct()
    keep = F.lit(False)
    for t in trees:
        one = F.col("tree") == t["name"]
        for patterns, wanted in ((t["include_patterns"], True), (t["exclude_patterns"], False)):
            if patterns:
                hit = F.col("path").rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))
                one &= hit if wanted else ~hit
        keep |= one
    return docs.where(keep).select("doc_id")


def effective_limits(spark, folder):
    """The nearest layer's default_limit and local_boost of each tree."""
    rows = table(spark, folder, "settings").where("tree is not null and layer is not null")
    near = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("layer", c)))[c]
    return rows.groupBy("tree").agg(near("default_limit").alias("default_limit"), F.round(near("local_boost").cast("double"), 4).alias("local_boost"))


def manifest_state(spark, folder):
    """What the committed runs leave recorded, in whole seconds."""
    log = table(spark, folder, "manifest").withColumn("mtime", F.date_trunc("second", "mtime"))
    key = F.concat("tree", F.lit(":"), changes.clean_path("path"))
    state = changes.recorded_state(log, table(spark, folder, "index_runs"), key)
    return state.select(F.col("key").alias("doc_id"), F.date_format("version", "yyyy-MM-dd HH:mm:ss").alias("mtime"))


def manifest_diff(spark, folder):
    """How many documents were added, modified and removed."""
    found = changes.document_changes(table(spark, folder, "chunks"), table(spark, folder, "manifest"), table(spark, folder, "index_runs"))
    return found.groupBy("change_kind").agg(F.count("*").alias("documents"))


def index_after_changes(spark, folder):
    """Chunks of an incremental update: those of added and modified documents, old rows of changed ones gone."""
    found = changes.document_changes(table(spark, folder, "chunks"), table(spark, folder, "manifest"), table(spark, folder, "index_runs"))
    fresh = found.where("change_kind <> 'removed'")
    return _rows(spark, folder).join(fresh, "doc_id", "left_semi").groupBy("tree").agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"))


def chunk_markdown(spark, folder):
    """The chunk tree of every crawled page."""
    docs = table(spark, folder, "documents").where("text is not null")
    files = docs.select(F.coalesce("source", F.lit("unknown")).alias("tree"), F.concat_ws("/", F.col("doc_id").cast("string"), "path").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return chunk_documents(files).select("id", "parent_id", "depth", "position", "byte_start", "byte_end", "sibling_count", title("hierarchy").alias("title"))


QUERIES = {f.__name__: f for f in (doc_listing, chunk_listing, get_by_id, get_by_path, json_results, slugify, slug_dedup, id_parts, rule_match, included_files, effective_limits, manifest_state, manifest_diff, index_after_changes, chunk_markdown)}

_SLUG = "coalesce(nullif(trim(regexp_replace(lower(regexp_replace(hierarchy[-1], '[^A-Za-z0-9_ \\-]', '', 'g')), '[ \\-]+', '-', 'g'), '-'), ''), 'heading')"
_STATE = r""", entries AS (
  SELECT tree || ':' || regexp_replace(regexp_replace(replace(path, '\', '/'), '(^|/)(\./)+', '\1', 'g'), '/+', '/', 'g') AS doc_id, run_id, op, date_trunc('second', mtime) AS mtime
  FROM manifest WHERE run_id IN (SELECT run_id FROM index_runs WHERE status = 'committed')
), state AS (SELECT doc_id, arg_max(op, run_id) AS op, arg_max(coalesce(mtime, TIMESTAMP '1900-01-01'), run_id) AS mtime FROM entries GROUP BY doc_id),
recorded AS (SELECT doc_id, mtime FROM state WHERE op = 'put'),
docs AS (SELECT doc_id, date_trunc('second', max(mtime)) AS mtime FROM chunks WHERE doc_id IS NOT NULL GROUP BY doc_id),
diff AS (SELECT coalesce(d.doc_id, r.doc_id) AS doc_id, CASE WHEN r.doc_id IS NULL THEN 'added' WHEN d.doc_id IS NULL THEN 'removed' ELSE 'modified' END AS change_kind
  FROM docs d FULL JOIN recorded r ON d.doc_id = r.doc_id WHERE r.doc_id IS NULL OR d.doc_id IS NULL OR d.mtime IS DISTINCT FROM r.mtime)"""
_RX = {n: glob_regex(p).replace("'", "''") for n, p in RULES.items()}

SQL = {
    "doc_listing": CURRENT + "SELECT doc_id, tree, path, count(*) AS chunks, sum(strlen(body)) AS bytes, arg_min(hierarchy[-1], id) AS title FROM cur GROUP BY doc_id, tree, path",
    "chunk_listing": CURRENT + "SELECT id, depth, array_to_string(hierarchy, ' > ') AS breadcrumb, strlen(body) AS bytes FROM cur",
    "get_by_id": CURRENT + "SELECT id, doc_id, depth, body FROM cur WHERE id = (SELECT max(id) FROM chunks)",
    "get_by_path": CURRENT + "SELECT id, position, hierarchy[-1] AS title FROM cur WHERE doc_id = (SELECT max(doc_id) FROM chunks)",
    "json_results": CURRENT + """SELECT id, '{"id":"' || id || '","doc_id":"' || doc_id || '","depth":' || depth || '}' AS json FROM cur""",
    "slugify": CURRENT + f"SELECT id, {_SLUG} AS slug FROM cur",
    "slug_dedup": CURRENT + f", b AS (SELECT id, doc_id, position, {_SLUG} AS base FROM cur WHERE depth > 0), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY position, id) - 1 AS k FROM b) SELECT id, CASE WHEN k > 0 THEN base || '-' || k ELSE base END AS slug FROM n",
    "id_parts": CURRENT + "SELECT id, split_part(id, ':', 1) AS tree, split_part(substr(id, instr(id, ':') + 1), '#', 1) AS path, CASE WHEN contains(id, '#') THEN split_part(id, '#', -1) END AS slug FROM cur",
    "rule_match": CURRENT + "SELECT DISTINCT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(path, '{r}') THEN '{n}' END" for n, r in _RX.items()) + ") AS rules FROM cur",
    "included_files": CURRENT
    + r""", pats AS (SELECT name, list_transform(include_patterns, lambda p: '^' || replace(replace(replace(replace(replace(p, '.', '\.'), '**/', '~'), '**', '.*'), '*', '.*'), '~', '(?:.*/)?') || '$') AS inc,
  list_transform(exclude_patterns, lambda p: '^' || replace(replace(replace(replace(replace(p, '.', '\.'), '**/', '~'), '**', '.*'), '*', '.*'), '~', '(?:.*/)?') || '$') AS exc FROM trees)
SELECT DISTINCT doc_id FROM cur JOIN pats ON name = tree
WHERE (inc IS NULL OR len(inc) = 0 OR len(list_filter(inc, lambda p: regexp_matches(path, p))) > 0) AND (exc IS NULL OR len(exc) = 0 OR len(list_filter(exc, lambda p: regexp_matches(path, p))) = 0)""",
    "effective_limits": "SELECT tree, arg_min(default_limit, layer) FILTER (default_limit IS NOT NULL) AS default_limit, round((arg_min(local_boost, layer) FILTER (local_boost IS NOT NULL))::DOUBLE, 4) AS local_boost FROM settings WHERE tree IS NOT NULL AND layer IS NOT NULL GROUP BY tree",
    "manifest_state": CURRENT + _STATE + "SELECT doc_id, strftime(mtime, '%Y-%m-%d %H:%M:%S') AS mtime FROM recorded",
    "manifest_diff": CURRENT + _STATE + "SELECT change_kind, count(*) AS documents FROM diff GROUP BY change_kind",
    "index_after_changes": CURRENT + _STATE + "SELECT tree, count(*) AS chunks, count(DISTINCT doc_id) AS documents FROM cur WHERE doc_id IN (SELECT doc_id FROM diff WHERE change_kind <> 'removed') GROUP BY tree",
}

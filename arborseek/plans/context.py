"""Queries of context analysis and keywords, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborseek.functions.terms import STOP, context_words, path_words
from arborseek.operators import context as ops
from arborseek.operators import index as ix
from arborseek.operators import keywords as kw
from arborseek.operators import ranking
from arborseek.plans.sql import CURRENT, TOKENS
from arborseek.query.compiler import Compiler
from arborseek.sources.tables import table


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return ix.index_rows(table(spark, folder, "chunks"))


def context_tokens(spark, folder):
    words = _rows(spark, folder).select("id", F.explode(context_words("body")).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("freq"))


def path_terms(spark, folder):
    return ops.path_terms(_rows(spark, folder)).select("id", "term", "weight", "source", "freq")


def merge_terms(spark, folder):
    rows = _rows(spark, folder)
    return ops.merge_terms(ops.path_terms(rows).unionByName(ops.body_terms(rows)))


def tfidf_keywords(spark, folder):
    """The five best keywords of every chunk by frequency, weight and context IDF."""
    index = ix.shared_index(spark, folder, table(spark, folder, "chunks"))
    rows = index.chunks
    merged = ops.merge_terms(ops.path_terms(rows).unionByName(ops.body_terms(rows)))
    ranked = ops.rank_terms(merged, index.terms.where("field = 'body'"), index.count)
    scored = ranked.select("id", "term", F.round("score", 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "term"))
    return scored.withColumn("place", place).where("place <= 5").drop("place")


def markdown_terms(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    return ops.markdown_terms(docs)


def _keywords(name: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return kw.keywords(_rows(spark, folder), name, limit=10).select("id", "term", F.round("score", 6).alias("score"))

    return run


def stored_keywords(spark, folder):
    """The stored extractions made sound: terms trimmed and lower-cased, positive scores, copies once, the best of each term."""
    rows = table(spark, folder, "keywords").select("doc_id", F.lower(F.trim("term")).alias("term"), F.col("score").cast("double").alias("score"), F.coalesce("algorithm", F.lit("")).alias("algorithm"))
    good = rows.where("doc_id is not null and term <> '' and score > 0")
    return good.groupBy("doc_id", "term").agg(F.round(F.max("score"), 4).alias("score"), F.countDistinct("algorithm").alias("algorithms"))


def include_inject(spark, folder):
    """Results of a word with two documents put before them: the first and the last by name."""
    index = ix.shared_index(spark, folder, table(spark, folder, "chunks"))
    found = ranking.candidates(Compiler(index).run(ops.build_query([("cache", 2.0)])), 10).withColumn("rank_in", F.col("rank_in").cast("long"))
    ends = index.chunks.agg(F.min("doc_id"), F.max("doc_id")).first()
    return ops.inject(found, [ends[0], ends[1]], index.chunks, 10).select("id", "doc_id", F.col("rank_in").cast("long").alias("rank_in"))


def self_exclude(spark, folder):
    """Results of a word without those of the document that is first among them."""
    index = ix.shared_index(spark, folder, table(spark, folder, "chunks"))
    found = ranking.candidates(Compiler(index).run(ops.build_query([("cache", 1.0)])), 20)
    own = found.where("rank_in = 1").select("doc_id")
    return found.join(own, "doc_id", "left_anti").select("id", "rank_in")


QUERIES = {
    "context_tokens": context_tokens,
    "path_terms": path_terms,
    "merge_terms": merge_terms,
    "tfidf_keywords": tfidf_keywords,
    "markdown_terms": markdown_terms,
    "rake": _keywords("rake"),
    "textrank": _keywords("textrank"),
    "yake": _keywords("yake"),
    "stored_keywords": stored_keywords,
    "include_inject": include_inject,
    "self_exclude": self_exclude,
}

_STOP = ", ".join(f"'{w}'" for w in STOP)
_CONTEXT = (
    r"""list_filter(regexp_split_to_array(lower({c}), '[\s!-/:-@\[-`{-~]+'), lambda w: strlen(w) >= 4 AND regexp_full_match(w, '[\p{L}\p{N}]+') AND w NOT IN (""" + _STOP + "))"
)
_PARTS = r"list_filter(regexp_split_to_array(lower({c}), '[/\\_\-.]+'), lambda w: strlen(w) >= 4 AND regexp_full_match(w, '[\p{L}\p{N}]+') AND w NOT IN (" + _STOP + "))"
_TERMS = (
    ", pt AS (SELECT id, unnest("
    + _PARTS.replace("{c}", "regexp_extract(path, '([^/]*)$', 1)")
    + ") AS term, 4.0::DOUBLE AS weight FROM cur UNION ALL SELECT id, unnest("
    + _PARTS.replace("{c}", "regexp_extract(path, '^(.*/)[^/]*$', 1)")
    + """), 3.0 FROM cur),
paths AS (SELECT id, term, max(weight) AS weight, CASE WHEN max(weight) = 4 THEN 'path:filename' ELSE 'path:dir' END AS source, count(*) AS freq FROM pt GROUP BY id, term),
bodies AS (SELECT id, term, 1.0::DOUBLE AS weight, 'body' AS source, count(*) AS freq FROM (SELECT id, unnest("""
    + _CONTEXT.replace("{c}", "body")
    + """) AS term FROM cur) GROUP BY id, term),
both_kinds AS (SELECT * FROM paths UNION ALL SELECT * FROM bodies),
merged AS (SELECT id, term, max(weight) AS weight, first(source ORDER BY weight DESC, source) AS source, sum(freq)::BIGINT AS freq FROM both_kinds GROUP BY id, term)"""
)
_FOUND = TOKENS + ", found AS (SELECT id, doc_id, row_number() OVER (ORDER BY s DESC, id) AS rank_in FROM (SELECT id, doc_id, sum(s) AS s FROM scored WHERE term = 'cache' GROUP BY ALL) ORDER BY s DESC, id LIMIT {n})"

SQL = {
    "context_tokens": CURRENT + "SELECT term, count(*) AS freq FROM (SELECT unnest(" + _CONTEXT.replace("{c}", "body") + ") AS term FROM cur) GROUP BY term",
    "path_terms": CURRENT + _TERMS + "SELECT id, term, weight, source, freq FROM paths",
    "merge_terms": CURRENT + _TERMS + "SELECT id, term, weight, source, freq FROM merged",
    "tfidf_keywords": TOKENS
    + _TERMS
    + """, scoring AS (SELECT id, m.term, round(freq * weight * (ln(((SELECT n FROM total) + 1) / (df + 1)) + 1), 6) AS score FROM merged m JOIN dfs ON dfs.term = m.term AND dfs.field = 'body')
SELECT id, term, score FROM scoring QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, term) <= 5""",
    "rake": CURRENT
    + r""", pieces AS (SELECT id, unnest(regexp_split_to_array(lower(body), '[^\p{L}\p{N}_\s''’\-]+|\n+')) AS piece, unnest(range(len(regexp_split_to_array(lower(body), '[^\p{L}\p{N}_\s''’\-]+|\n+')))) AS k FROM cur WHERE body <> ''),
found AS (SELECT id, k, regexp_extract_all(piece, '[\p{L}\p{N}]+(?:[''’\-][\p{L}\p{N}]+)*') AS w FROM pieces),
each AS (SELECT id, k, unnest(w) AS w, unnest(range(len(w))) AS i FROM found),
runs AS (SELECT *, (w IN (""" + _STOP + r""") OR regexp_full_match(w, '\p{Nd}+'))::INT AS bar, sum((w IN (""" + _STOP + r""") OR regexp_full_match(w, '\p{Nd}+'))::INT) OVER (PARTITION BY id, k ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM each),
inside AS (SELECT id, k, run, w, (row_number() OVER (PARTITION BY id, k, run ORDER BY i) - 1) AS j FROM runs WHERE bar = 0),
phr AS (SELECT id, list(w ORDER BY j) AS p FROM inside GROUP BY id, k, run, j // 3),
degrees AS (SELECT id, w, count(*) AS freq, sum(n) AS degree FROM (SELECT id, unnest(p) AS w, len(p) AS n FROM phr) GROUP BY id, w),
spread AS (SELECT id, p, unnest(p) AS w FROM (SELECT DISTINCT id, p FROM phr)),
sums AS (SELECT id, array_to_string(p, ' ') AS term, max(total) AS score FROM (SELECT id, p, sum(degree / freq) AS total FROM spread JOIN degrees USING (id, w) GROUP BY id, p) GROUP BY id, array_to_string(p, ' '))
SELECT id, term, round(score, 6) AS score FROM sums QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, term) <= 10""",
    "stored_keywords": "SELECT doc_id, lower(trim(term, ' ')) AS term, round(max(score::DOUBLE), 4) AS score, count(DISTINCT coalesce(algorithm, '')) AS algorithms FROM keywords WHERE doc_id IS NOT NULL AND trim(term, ' ') <> '' AND score > 0 GROUP BY ALL",
    "include_inject": _FOUND.replace("{n}", "10")
    + """, wanted AS (SELECT min(doc_id) AS doc_id, 0 AS place FROM cur UNION ALL SELECT max(doc_id), 1 FROM cur),
firsts AS (SELECT c.doc_id, wanted.place AS place, min(id) AS id FROM cur c JOIN wanted USING (doc_id) WHERE c.doc_id NOT IN (SELECT doc_id FROM found) GROUP BY ALL)
SELECT id, doc_id, rank_in FROM (SELECT id, doc_id, place - 2 AS rank_in FROM firsts UNION ALL SELECT id, doc_id, rank_in FROM found) ORDER BY rank_in, id LIMIT 10""",
    "self_exclude": _FOUND.replace("{n}", "20") + "SELECT id, rank_in FROM found WHERE doc_id NOT IN (SELECT doc_id FROM found WHERE rank_in = 1)",
}

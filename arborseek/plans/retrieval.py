"""Queries of postings, the query language, scoring and ranking, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborseek.operators import highlight, ranking, scoring, similar
from arborseek.operators import index as ix
from arborseek.plans.sql import CURRENT, TOKENS
from arborseek.query.compiler import Compiler, expand
from arborseek.query.parser import parse
from arborseek.sources.tables import table


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return ix.index_rows(table(spark, folder, "chunks"))


def _index(spark: SparkSession, folder: str) -> ix.Index:
    return ix.shared_index(spark, folder, table(spark, folder, "chunks"))


def search_scores(query: str, fuzzy: int = 0):
    """All matches of a query with their scores."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = Compiler(_index(spark, folder), fuzzy=fuzzy).run(parse(query))
        return found.select("id", F.round("score", 5).alias("score"))

    return run


def tokenize_counts(spark, folder):
    found = ix.tokens(_rows(spark, folder))
    return found.groupBy("field").agg(F.count("*").alias("tokens"), F.countDistinct("term").alias("distinct_terms"))


def postings(spark, folder):
    return ix.postings(_rows(spark, folder)).select("field", "term", "id", "tf", "len", F.col("positions")[0].alias("first_pos"))


def term_stats(spark, folder):
    return ix.term_stats(ix.postings(_rows(spark, folder)))


def field_stats(spark, folder):
    return ix.Index.of(_rows(spark, folder)).stats.select("field", "docs", F.round("avg_len", 6).alias("avg_len"))


def context_idf(spark, folder):
    index = _index(spark, folder)
    return index.terms.where("field = 'body'").select("term", F.round(scoring.context_idf("df", index.count), 6).alias("idf"))


def bm25_top(spark, folder):
    found = Compiler(_index(spark, folder)).run(parse("body:(heading OR cache)"))
    return found.select("id", F.round("score", 5).alias("score")).orderBy(F.desc("score"), "id").limit(10)


def fuzzy_vocab_map(spark, folder):
    found = expand(_index(spark, folder), ["cahce", "heading", "metric"], ("body", "hierarchy", "path"))
    return found.groupBy("word").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def heading_boost(spark, folder):
    return _rows(spark, folder).select("id", F.round(scoring.heading_boost("depth"), 6).alias("boost"))


def locality_boost(spark, folder):
    return scoring.locality_boost(_rows(spark, folder), table(spark, folder, "trees")).select("id", "locality")


def _candidates(spark, folder, limit=500):
    """Candidates of one word with made-up scores that SQL can repeat: a sum of body and title scores."""
    return ranking.candidates(Compiler(_index(spark, folder)).run(parse("cache OR heading")).withColumn("score", F.round("score", 5)), limit)


def top_candidates(spark, folder):
    return _candidates(spark, folder, 100).select("id", "score", "rank_in")


def tree_normalize(spark, folder):
    return ranking.normalize(_candidates(spark, folder)).select("id", F.round("score", 6).alias("score"))


def elbow_cutoff(spark, folder):
    return ranking.elbow(_candidates(spark, folder), 0.95, 100).select("id", "score", "rank_in")


def sibling_rss(spark, folder):
    slim = _rows(spark, folder).select("id", "parent_id", "sibling_count")
    found = ranking.sibling_rss(_candidates(spark, folder).join(slim, "id"))
    return found.select("parent_id", "n", F.round("score", 5).alias("score"))


def _params(**kw):
    return ranking.SearchParams(fuzzy=0, **kw)


def hier_fold(spark, folder):
    index = _index(spark, folder)
    cands = ranking.boosted(_candidates(spark, folder), index.chunks, table(spark, folder, "trees"))
    return ranking.fold(cands, index.chunks).select("id", "doc_id", F.round("score", 5).alias("score"), "is_aggregated", F.size("constituents").alias("constituents"))


# cases of the roll-up: candidates (case, slug, parent's slug, sibling count, score) in rank order, "" the document, and inner nodes
FOLD_CASES = (
    ("two of two", [("lid", "", 2, 3.0), ("spout", "", 2, 4.0)], {"": (None, 1)}),
    ("two of nine", [("lid", "", 9, 3.0), ("spout", "", 9, 4.0)], {"": (None, 1)}),
    ("below a result", [("", None, 1, 9.0), ("lid", "", 2, 3.0), ("spout", "", 2, 4.0)], {"": (None, 1)}),
    ("parent unknown", [("lid", "", 2, 3.0), ("spout", "", 2, 4.0)], {}),
    ("two levels", [("a-x", "a", 2, 2.0), ("a-y", "a", 2, 2.0), ("b-x", "b", 2, 2.0), ("b-y", "b", 2, 2.0)], {"": (None, 1), "a": ("", 2), "b": ("", 2)}),
    ("above comes late", [("a-x", "a", 3, 6.0), ("a-y", "a", 3, 8.0), ("", None, 1, 1.0)], {}),
    ("only one level", [("a-x", "a", 2, 6.0), ("a-y", "a", 2, 8.0), ("b-x", "b", 2, 1.0)], {"": (None, 1), "a": ("", 9), "b": ("", 9)}),
)


def fold_cases(spark, folder):
    """Roll-up of fixed cases: merged, below the threshold, claimed, without parent, over two levels, from above."""
    name = lambda case, slug: case if not slug else f"{case}#{slug}"
    above = lambda case, parent: None if parent is None else name(case, parent)
    cands = [(name(c, s), c, "t", above(c, p), n, score, i) for c, rows, _ in FOLD_CASES for i, (s, p, n, score) in enumerate(rows, 1)]
    nodes = [(name(c, s), above(c, p), n) for c, _, known in FOLD_CASES for s, (p, n) in known.items()]
    found = ranking.fold(
        spark.createDataFrame(cands, "id string, doc_id string, tree string, parent_id string, sibling_count int, score double, rank_in int"),
        spark.createDataFrame(nodes, "id string, parent_id string, sibling_count int"),
        0.5,
    )
    return found.select("id", F.round("score", 6).alias("score"), "is_aggregated", F.size("constituents").alias("constituents"))


def search(spark, folder, query="cache OR heading", **kw):
    index = _index(spark, folder)
    found = Compiler(index).run(parse(query))
    return ranking.pipeline(found, index.chunks, table(spark, folder, "trees"), _params(**kw)).select("id", "doc_id", "tree", F.round("score", 6).alias("score"), "is_aggregated", "rank_in")


def search_in_tree(spark, folder):
    """Results of one tree without roll-up, over scores rounded to five digits, so that ties are the same everywhere."""
    index = _index(spark, folder)
    found = Compiler(index).run(parse("cache OR heading")).withColumn("score", F.round("score", 5))
    params = _params(trees=("handbook",), aggregate=False, cutoff_ratio=0.5, limit=20)
    return ranking.pipeline(found, index.chunks, table(spark, folder, "trees"), params).select("id", "doc_id", "tree", F.round("score", 4).alias("score"), "rank_in")


def flat_stats(spark, folder):
    """How many rows each phase leaves without roll-up, and why the elbow cut."""
    index = _index(spark, folder)
    found = Compiler(index).run(parse("cache OR heading")).withColumn("score", F.round("score", 5))
    params = _params(trees=("handbook",), aggregate=False, cutoff_ratio=0.5, limit=20)
    return ranking.pipeline_stats(found, index.chunks, table(spark, folder, "trees"), params)


def pipeline_stats(spark, folder):
    index = _index(spark, folder)
    return ranking.pipeline_stats(Compiler(index).run(parse("cache OR heading")), index.chunks, table(spark, folder, "trees"), _params())


def range_merge(spark, folder):
    """Byte ranges of all lines of all bodies, widened to touch, and merged; empty lines part them."""
    each = highlight.lines(_rows(spark, folder)).where("end > start")
    return highlight.merge_ranges(each.select("id", "start", (F.col("end") + 1).alias("end")))


def matching_lines(spark, folder):
    return highlight.matching_lines(_rows(spark, folder), ["cache", "heading"])


def match_ranges(spark, folder):
    found = highlight.with_ranges(_rows(spark, folder).select("id", "body"), "body", ["cache", "heading"])
    return found.select("id", F.inline("ranges")).select("id", "offset", "length")


def snippet(spark, folder):
    """The fragments of all hits of a word."""
    index = _index(spark, folder)
    hits = Compiler(index).run(parse("body:cache")).select("id").join(index.chunks.select("id", "body"), "id")
    return highlight.with_snippet(hits, "body", {"cache": 1.0}).select("id", "snippet")


def more_like_this(spark, folder):
    """The ten chunks most like the one with the smallest id among those of some length."""
    index = _index(spark, folder)
    source = index.chunks.where("length(body) > 200").agg(F.min("id")).first()[0]
    found = similar.more_like(similar.source_of_chunk(index, source), index, exclude=(source,))
    return found.select("id", F.round("score", 5).alias("score")).orderBy(F.desc("score"), "id").limit(10)


def more_like_each(spark, folder):
    """The ten chunks most like each query chunk, out of all chunks. Queries are the chunks whose id's hash is divisible by 50."""
    index = ix.Index.of_words(_rows(spark, folder))
    return similar.more_like_each(index.words.where("cast(conv(substring(md5(id), 1, 8), 16, 10) as bigint) % 50 = 0"), index)


def similar_terms(spark, folder):
    """The query terms that the same source gives."""
    index = _index(spark, folder)
    source = index.chunks.where("length(body) > 200").agg(F.min("id")).first()[0]
    return similar.select_terms(similar.source_of_chunk(index, source), index).select("field", "term", F.round("weight", 6).alias("weight"))


def batched_terms(spark, folder):
    """Many one-word queries in one plan: the best chunk body for each body term.

    A score depends on frequency and length alone, so of equal ones only the first id is kept before the shuffle by
    term: a term of all chunks is left with as many rows as it has such pairs.
    """
    index = _index(spark, folder)
    pairs = index.postings.where("field = 'body'").groupBy("term", "tf", "len").agg(F.count("*").alias("chunks"), F.min("id").alias("id"))
    known = pairs.withColumn("df", F.sum("chunks").over(Window.partitionBy("term"))).crossJoin(F.broadcast(index.stats.where("field = 'body'").select("avg_len")))
    scored = known.select("term", "id", F.round(scoring.bm25("tf", "len", "avg_len", scoring.bm25_idf("df", index.count)), 5).alias("score"))
    best = scored.groupBy("term").agg(F.min(F.struct((-F.col("score")).alias("minus"), "id")).alias("best"))
    return best.select("term", F.col("best.id").alias("id"), (-F.col("best.minus")).alias("score"))


QUERIES = {
    "tokenize_counts": tokenize_counts,
    "postings": postings,
    "term_stats": term_stats,
    "field_stats": field_stats,
    "context_idf": context_idf,
    "bm25_term": search_scores("body:cache"),
    "bm25_multi_field": search_scores("cache"),
    "bm25_top": bm25_top,
    "bool_and": search_scores("cache heading"),
    "bool_or": search_scores("cache OR heading"),
    "bool_not": search_scores("cache -heading"),
    "not_only": search_scores("-cache"),
    "field_query": search_scores("title:(cache OR heading)"),
    "field_not": search_scores("body:(cache -heading)"),
    "tree_filter": search_scores("cache tree:(handbook OR research)"),
    "boosted_or": search_scores("cache^2.5 OR heading^0.5"),
    "phrase": search_scores('body:"worth noting"'),
    "phrase_or_not": search_scores('"worth noting" OR -cache'),
    "hyphen_phrase": search_scores("body:worth-noting"),
    "fuzzy_d1": search_scores("cahce", fuzzy=1),
    "fuzzy_d2": search_scores("cahcee", fuzzy=2),
    "fuzzy_mixed": search_scores("cahce^2 OR haeding OR body:metrc", fuzzy=1),
    "empty_query": search_scores("..."),
    "fuzzy_vocab_map": fuzzy_vocab_map,
    "heading_boost": heading_boost,
    "locality_boost": locality_boost,
    "top_candidates": top_candidates,
    "tree_normalize": tree_normalize,
    "elbow_cutoff": elbow_cutoff,
    "sibling_rss": sibling_rss,
    "hier_fold": hier_fold,
    "fold_cases": fold_cases,
    "search": search,
    "search_in_tree": search_in_tree,
    "flat_stats": flat_stats,
    "pipeline_stats": pipeline_stats,
    "range_merge": range_merge,
    "matching_lines": matching_lines,
    "match_ranges": match_ranges,
    "snippet": snippet,
    "more_like_this": more_like_this,
    "more_like_each": more_like_each,
    "similar_terms": similar_terms,
    "batched_terms": batched_terms,
}

_BOTH = "SELECT id, sum(s) FILTER (term = 'cache') AS a, sum(s) FILTER (term = 'heading') AS b FROM scored WHERE term IN ('cache', 'heading') GROUP BY id"
_CANDS = TOKENS + """, cands AS (SELECT id, doc_id, tree, score, row_number() OVER (ORDER BY score DESC, id) AS rank_in FROM (
  SELECT id, doc_id, tree, round(sum(s), 5) AS score FROM scored WHERE term IN ('cache', 'heading') GROUP BY ALL) ORDER BY score DESC, id LIMIT {n})"""
_PHRASE = """, starts AS (
  SELECT a.id, a.field, count(*) AS tf FROM tok a JOIN tok b ON a.id = b.id AND a.field = b.field AND b.pos = a.pos + 1 WHERE a.term = 'worth' AND b.term = 'noting' GROUP BY ALL
), idfs AS (SELECT field, sum(ln(1 + ((SELECT n FROM total) - df + 0.5) / (df + 0.5))) AS idf FROM dfs WHERE term IN ('worth', 'noting') GROUP BY field),
phr AS (SELECT id, field, CASE field WHEN 'hierarchy' THEN 3 WHEN 'tags' THEN 5 WHEN 'path' THEN 12 ELSE 1 END * idf * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) AS s
  FROM starts JOIN lens USING (id, field) JOIN avgs USING (field) JOIN idfs USING (field))"""
_NEAR = "abs(length(term) - {n}) <= 1 AND damerau_levenshtein(term, '{w}') <= 1"
_SOURCE = """, src AS (SELECT min(id) AS id FROM cur WHERE length(body) > 200),
picked AS (
  SELECT p.field, p.term, df, tf * ln(1 + ((SELECT n FROM total) - df + 0.5) / (df + 0.5)) AS w FROM post p JOIN dfs USING (field, term)
  WHERE p.id = (SELECT id FROM src) AND length(p.term) BETWEEN 3 AND 40 AND p.term NOT IN ({stop}) ORDER BY w DESC, p.field, p.term LIMIT 25
), weights AS (SELECT field, term, df, w / (SELECT max(w) FROM picked) AS weight FROM picked)"""
_FLAT = (
    TOKENS
    + """, tops AS (SELECT id, doc_id, tree, score, row_number() OVER (ORDER BY score DESC, id) AS rank_in FROM (
  SELECT id, doc_id, tree, round(sum(s), 5) AS score FROM scored WHERE term IN ('cache', 'heading') AND tree = 'handbook' GROUP BY ALL) ORDER BY score DESC, id LIMIT 1000),
known AS (SELECT name, bool_or(is_global) AS is_global FROM trees GROUP BY name),
boosted AS (SELECT t.id, t.doc_id, t.tree, rank_in, score * CASE WHEN depth <= 1 THEN 5 ELSE 5 * pow(0.7, depth - 1) END * CASE WHEN is_global THEN 1.0 ELSE 1.5 END AS score FROM tops t JOIN cur USING (id) LEFT JOIN known ON name = t.tree),
nx AS (SELECT *, lead(score) OVER (ORDER BY rank_in) AS nxt FROM boosted),
cut AS (SELECT min(CASE WHEN nxt IS NULL THEN NULL WHEN score <= 0 THEN rank_in - 1 WHEN nxt <= 0 THEN rank_in WHEN nxt / score < 0.5 THEN rank_in END) AS c, count(*) AS n FROM nx)
"""
)
_STOP = ", ".join(f"'{w}'" for w in similar.STOP)
_LINES = CURRENT + r""", each AS (SELECT id, unnest(string_split(body, chr(10))) AS text, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS line FROM cur WHERE body IS NOT NULL)"""

SQL = {
    "tokenize_counts": TOKENS + "SELECT field, count(*) AS tokens, count(DISTINCT term) AS distinct_terms FROM tok GROUP BY field",
    "postings": TOKENS + "SELECT field, term, id, count(*) AS tf, any_value(len) AS len, min(pos) AS first_pos FROM tok JOIN lens USING (id, field) GROUP BY field, term, id",
    "term_stats": TOKENS + "SELECT field, term, df FROM dfs",
    "field_stats": TOKENS + "SELECT field, count(*) AS docs, round(sum(len) / (SELECT n FROM total)::DOUBLE, 6) AS avg_len FROM lens GROUP BY field",
    "context_idf": TOKENS + "SELECT term, round(ln(((SELECT n FROM total) + 1) / (df + 1)) + 1, 6) AS idf FROM dfs WHERE field = 'body'",
    "bm25_term": TOKENS + "SELECT id, round(sum(s), 5) AS score FROM scored WHERE term = 'cache' AND field = 'body' GROUP BY id",
    "bm25_multi_field": TOKENS + "SELECT id, round(sum(s), 5) AS score FROM scored WHERE term = 'cache' GROUP BY id",
    "bm25_top": TOKENS + "SELECT id, round(sum(s), 5) AS score FROM scored WHERE term IN ('heading', 'cache') AND field = 'body' GROUP BY id ORDER BY score DESC, id LIMIT 10",
    "bool_and": TOKENS + f"SELECT id, round(a + b, 5) AS score FROM ({_BOTH}) WHERE a IS NOT NULL AND b IS NOT NULL",
    "bool_or": TOKENS + f"SELECT id, round(coalesce(a, 0) + coalesce(b, 0), 5) AS score FROM ({_BOTH})",
    "bool_not": TOKENS + f"SELECT id, round(a, 5) AS score FROM ({_BOTH}) WHERE a IS NOT NULL AND b IS NULL",
    "not_only": TOKENS + "SELECT id, 1.0::DOUBLE AS score FROM cur WHERE id NOT IN (SELECT id FROM post WHERE term = 'cache')",
    "field_query": TOKENS + "SELECT id, round(sum(s), 5) AS score FROM scored WHERE term IN ('cache', 'heading') AND field = 'hierarchy' GROUP BY id",
    "field_not": TOKENS + "SELECT id, round(sum(s) + 1, 5) AS score FROM scored WHERE term = 'cache' AND field = 'body' AND id NOT IN (SELECT id FROM post WHERE term = 'heading' AND field = 'body') GROUP BY id",
    "tree_filter": TOKENS + "SELECT id, round(sum(s), 5) AS score FROM scored WHERE term = 'cache' AND tree IN ('handbook', 'research') GROUP BY id",
    "boosted_or": TOKENS + f"SELECT id, round(2.5 * coalesce(a, 0) + 0.5 * coalesce(b, 0), 5) AS score FROM ({_BOTH})",
    "phrase": TOKENS + _PHRASE + "SELECT id, round(sum(s), 5) AS score FROM phr WHERE field = 'body' GROUP BY id",
    "hyphen_phrase": TOKENS + _PHRASE + "SELECT id, round(sum(s), 5) AS score FROM phr WHERE field = 'body' GROUP BY id",
    "phrase_or_not": TOKENS
    + _PHRASE
    + ", sums AS (SELECT id, sum(s) AS s FROM phr GROUP BY id), has AS (SELECT DISTINCT id FROM post WHERE term = 'cache') SELECT c.id, round(coalesce(s, 0) + CASE WHEN h.id IS NULL THEN 1 ELSE 0 END, 5) AS score FROM cur c LEFT JOIN sums USING (id) LEFT JOIN has h ON h.id = c.id WHERE s IS NOT NULL OR h.id IS NULL",
    "fuzzy_d1": TOKENS + f"SELECT id, round(sum(CASE field WHEN 'hierarchy' THEN 3 WHEN 'tags' THEN 5 WHEN 'path' THEN 12 ELSE 1 END)::DOUBLE, 5) AS score FROM (SELECT DISTINCT id, field FROM post WHERE {_NEAR.format(n=5, w='cahce')}) GROUP BY id",
    "fuzzy_d2": TOKENS + f"SELECT id, round(sum(CASE field WHEN 'hierarchy' THEN 3 WHEN 'tags' THEN 5 WHEN 'path' THEN 12 ELSE 1 END)::DOUBLE, 5) AS score FROM (SELECT DISTINCT id, field FROM post WHERE abs(length(term) - 6) <= 2 AND damerau_levenshtein(term, 'cahcee') <= 2) GROUP BY id",
    "fuzzy_mixed": TOKENS
    + f""", found AS (SELECT DISTINCT id, field, 2.0 AS w FROM post WHERE {_NEAR.format(n=5, w='cahce')} UNION ALL SELECT DISTINCT id, field, 1.0 FROM post WHERE {_NEAR.format(n=7, w='haeding')} UNION ALL SELECT DISTINCT id, field, 1.0 FROM post WHERE field = 'body' AND {_NEAR.format(n=5, w='metrc')})
SELECT id, round(sum(w * CASE field WHEN 'hierarchy' THEN 3 WHEN 'tags' THEN 5 WHEN 'path' THEN 12 ELSE 1 END)::DOUBLE, 5) AS score FROM found GROUP BY id""",
    "empty_query": "SELECT id, 0.0::DOUBLE AS score FROM chunks WHERE false",
    "fuzzy_vocab_map": TOKENS + ", words(word) AS (VALUES ('cahce'), ('heading'), ('metric')) SELECT word, list_sort(list(DISTINCT term)) AS terms FROM words, dfs WHERE field <> 'tags' AND abs(length(term) - length(word)) <= 1 AND damerau_levenshtein(term, word) <= 1 GROUP BY word",
    "heading_boost": CURRENT + "SELECT id, round(CASE WHEN depth <= 1 THEN 5 ELSE 5 * pow(0.7, depth - 1) END, 6)::DOUBLE AS boost FROM cur",
    "locality_boost": CURRENT + "SELECT c.id, CASE WHEN t.is_global THEN 1.0 ELSE 1.5 END::DOUBLE AS locality FROM cur c LEFT JOIN (SELECT name, bool_or(is_global) AS is_global FROM trees GROUP BY name) t ON t.name = c.tree",
    "top_candidates": _CANDS.replace("{n}", "100") + "SELECT id, score, rank_in FROM cands",
    "tree_normalize": _CANDS.replace("{n}", "500") + "SELECT id, round(CASE WHEN (SELECT count(DISTINCT tree) FROM cands) > 1 THEN score / CASE WHEN max(score) OVER (PARTITION BY tree) > 0 THEN max(score) OVER (PARTITION BY tree) ELSE 1 END ELSE score END, 6) AS score FROM cands",
    "elbow_cutoff": _CANDS.replace("{n}", "500")
    + """, nx AS (SELECT *, lead(score) OVER (ORDER BY rank_in) AS nxt FROM cands),
cut AS (SELECT min(CASE WHEN nxt IS NULL THEN NULL WHEN score <= 0 THEN rank_in - 1 WHEN nxt <= 0 THEN rank_in WHEN nxt / score < 0.95 THEN rank_in END) AS c, count(*) AS n FROM nx)
SELECT id, score, rank_in FROM nx, cut WHERE rank_in <= least(coalesce(c, n), 100) OR n = 1""",
    "sibling_rss": _CANDS.replace("{n}", "500") + ", sib AS (SELECT parent_id, count(*) AS n, max(sibling_count) AS m, sqrt(sum(score * score)) AS s FROM cands JOIN cur USING (id) WHERE parent_id IS NOT NULL GROUP BY parent_id) SELECT parent_id, n, round(s, 5) AS score FROM sib WHERE n >= 2 AND m > 0 AND n / m >= 0.1",
    "range_merge": _LINES
    + """, spans AS (SELECT id, line, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, strlen(text) AS n FROM each),
kept AS (SELECT id, s, s + n + 1 AS e FROM spans WHERE n > 0),
marked AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM kept),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM marked)
SELECT id, min(s) AS start, max(e) AS "end" FROM islands GROUP BY id, k""",
    "matching_lines": _LINES + r"SELECT id, line, text FROM each WHERE list_has_any(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ['cache', 'heading'])",
    "more_like_this": TOKENS
    + _SOURCE.replace("{stop}", _STOP)
    + """, hits AS (SELECT p.id, weight * CASE field WHEN 'hierarchy' THEN 3 WHEN 'tags' THEN 5 WHEN 'path' THEN 12 ELSE 1 END * ln(1 + ((SELECT n FROM total) - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) AS s
  FROM post p JOIN weights USING (field, term) JOIN lens USING (id, field) JOIN avgs USING (field) WHERE p.id <> (SELECT id FROM src) AND p.doc_id <> (SELECT id FROM src))
SELECT id, round(sum(s), 5) AS score FROM hits GROUP BY id ORDER BY score DESC, id LIMIT 10""",
    "more_like_each": TOKENS
    + """, srcs AS (SELECT id AS source FROM cur WHERE ('0x' || substr(md5(id), 1, 8))::UBIGINT % 50 = 0),
own AS (SELECT source, p.field, p.term, df, tf * ln(1 + ((SELECT n FROM total) - df + 0.5) / (df + 0.5)) AS w FROM srcs JOIN post p ON p.id = source JOIN dfs USING (field, term)
  WHERE length(p.term) BETWEEN 3 AND 40 AND p.term NOT IN ({stop}) QUALIFY row_number() OVER (PARTITION BY source ORDER BY w DESC, p.field, p.term) <= 25),
hits AS (SELECT source, p.id, w / max(w) OVER (PARTITION BY source) AS weight, p.field, tf, len, avg_len, df FROM post p JOIN own USING (field, term) JOIN lens l ON l.id = p.id AND l.field = p.field JOIN avgs ON avgs.field = p.field),
sums AS (SELECT source, id, round(sum(weight * CASE field WHEN 'hierarchy' THEN 3 WHEN 'tags' THEN 5 WHEN 'path' THEN 12 ELSE 1 END * ln(1 + ((SELECT n FROM total) - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 5) AS score
  FROM hits WHERE id <> source AND id NOT IN (SELECT c.id FROM cur c WHERE c.doc_id = source) GROUP BY source, id)
SELECT source, id, score FROM sums QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, id) <= 10""".replace("{stop}", _STOP),
    "search_in_tree": _FLAT + "SELECT id, doc_id, tree, round(score, 4) AS score, rank_in FROM nx, cut WHERE rank_in <= least(coalesce(c, n), 500, 20) OR n = 1",
    "flat_stats": _FLAT
    + """SELECT n AS candidates, n AS aggregated, least(coalesce(c, n), 500) AS after_elbow,
  CASE WHEN n <= 1 THEN 'too_few_results' WHEN coalesce(c, n) > 500 THEN 'max_results_reached' WHEN c IS NULL THEN 'no_elbow' ELSE 'ratio_below_threshold' END AS cutoff FROM cut""",
    "snippet": CURRENT
    + r""", parts AS (SELECT id, body, regexp_extract_all(body, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS t FROM cur WHERE body IS NOT NULL),
each AS (SELECT id, unnest(t) AS t, unnest(range(len(t))) AS i FROM parts),
placed AS (SELECT id, i, t, length(t) AS n, coalesce(sum(length(t)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spot FROM each),
hits AS (SELECT id, spot, spot + n AS stop FROM placed WHERE lower(t) = 'cache'),
windows AS (SELECT r.id, r.spot AS last, min(l.spot) AS start, count(*) AS n FROM hits r JOIN hits l ON l.id = r.id AND l.spot <= r.spot AND (r.stop - l.spot <= 150 OR l.spot = r.spot) GROUP BY r.id, r.spot),
best AS (SELECT id, start FROM windows QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, last) = 1),
cuts AS (SELECT id, start, body, substr(body, start + 1, 150) AS cut, length(regexp_extract(substr(body, start + 1, 150), '(?s)^(.*)\s\S*$', 1)) AS blank, regexp_matches(substr(body, start + 1, 150), '\s') AS has FROM best JOIN parts USING (id)),
sized AS (SELECT id, start, CASE WHEN start + 150 < length(body) AND has AND EXISTS (SELECT 1 FROM hits h WHERE h.id = c.id AND h.stop > start AND h.stop <= start + blank) THEN blank ELSE length(cut) END AS size FROM cuts c),
shown AS (SELECT p.id, i, CASE WHEN lower(t) = 'cache' AND spot >= start AND spot + n <= start + size THEN '<b>' || t || '</b>' ELSE substr(t, greatest(start - spot, 0) + 1, least(spot + n, start + size) - greatest(spot, start)) END AS t
  FROM placed p JOIN sized s ON s.id = p.id AND spot < start + size AND spot + n > start)
SELECT id, string_agg(t, '' ORDER BY i) AS snippet FROM shown GROUP BY id""",
    "match_ranges": CURRENT
    + r""", parts AS (SELECT id, regexp_extract_all(body, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS t FROM cur WHERE body IS NOT NULL),
each AS (SELECT id, unnest(t) AS t, unnest(range(len(t))) AS i FROM parts),
placed AS (SELECT id, t, coalesce(sum(strlen(t)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spot FROM each)
SELECT id, spot AS "offset", strlen(t) AS length FROM placed WHERE lower(t) IN ('cache', 'heading')""",
    "fold_cases": """SELECT * FROM (VALUES ('two of two', 5.0::DOUBLE, true, 2), ('two of nine#lid', 3.0, false, 0), ('two of nine#spout', 4.0, false, 0), ('below a result', 9.0, false, 0),
  ('parent unknown#lid', 3.0, false, 0), ('parent unknown#spout', 4.0, false, 0), ('two levels', 4.0, true, 4), ('above comes late', 10.0, true, 2),
  ('only one level#a', 10.0, true, 2), ('only one level#b-x', 1.0, false, 0)) AS t(id, score, is_aggregated, constituents)""",
    "similar_terms": TOKENS + _SOURCE.replace("{stop}", _STOP) + "SELECT field, term, round(weight, 6) AS weight FROM weights",
    "batched_terms": TOKENS
    + """SELECT term, id, round(s, 5) AS score FROM scored WHERE field = 'body' QUALIFY row_number() OVER (PARTITION BY term ORDER BY round(s, 5) DESC, id) = 1""",
}

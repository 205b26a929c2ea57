"""Context search: weighted terms of source files, ranked and turned into a query."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborseek.chunking import frontmatter
from arborseek.functions.markdown import headings
from arborseek.functions.stem import stem_column
from arborseek.functions.terms import MIN_LENGTH, STOP, context_words, path_words
from arborseek.operators import scoring
from arborseek.query.ast import Boost, Expr, Term, any_of

HEADING_WEIGHTS = {1: 3.0, 2: 2.0, 3: 2.0, 4: 1.5, 5: 1.5, 6: 1.5}
SOURCES = {1: "md:h1", 2: "md:h2-3", 3: "md:h2-3", 4: "md:h4-6", 5: "md:h4-6", 6: "md:h4-6"}
RULE_BOOST = 2.0
TERMS = 50


def body_terms(rows: DataFrame, key: str = "id", column: str = "body", shortest: int = MIN_LENGTH, stop: list[str] = STOP) -> DataFrame:
    """``(key, term, weight, source, freq)`` of plain text: weight 1."""
    each = rows.select(key, F.explode(context_words(column, shortest, stop)).alias("term"))
    return each.groupBy(key, "term").agg(F.lit(1.0).alias("weight"), F.lit("body").alias("source"), F.count("*").alias("freq"))


def path_terms(rows: DataFrame, key: str = "id", column: str = "path", shortest: int = MIN_LENGTH, stop: list[str] = STOP) -> DataFrame:
    """``(key, term, weight, source, freq)`` of paths; a term of folder and file name has the greater weight."""
    each = rows.select(key, F.inline(path_words(column, shortest, stop)))
    counted = each.groupBy(key, "term").agg(F.max("weight").alias("weight"), F.count("*").alias("freq"))
    return counted.select(key, "term", "weight", F.when(F.col("weight") == 4, "path:filename").otherwise("path:dir").alias("source"), "freq")


def markdown_terms(rows: DataFrame, key: str = "id", column: str = "content", shortest: int = MIN_LENGTH, stop: list[str] = STOP) -> DataFrame:
    """``(key, term, weight, source, freq)`` of Markdown: headings weigh by level, the text without their lines 1. Front matter gives none."""

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for k, text in zip(b[key], b[column], strict=True):
                text, rest, at = frontmatter(text or "")[1], [], 0
                for h in headings(text, nested=True):
                    out.append((k, h.text, HEADING_WEIGHTS[h.level], SOURCES[h.level]))
                    rest.append(text[at : h.start])
                    at = h.end
                out.append((k, "\n".join([*rest, text[at:]]), 1.0, "body"))
            yield pd.DataFrame(out, columns=[key, "text", "weight", "source"])

    parts = rows.select(key, column).mapInPandas(run, f"{key} string, text string, weight double, source string")
    each = parts.select(key, F.explode(context_words("text", shortest, stop)).alias("term"), "weight", "source")
    return each.groupBy(key, "term", "weight", "source").agg(F.count("*").alias("freq"))


def merge_terms(found: DataFrame, key: str = "id") -> DataFrame:
    """One row a term: frequencies add up; weight and source are those of the greatest weight, of equals the first source by name."""
    best = F.min(F.struct((-F.col("weight")).alias("w"), "source"))
    merged = found.groupBy(key, "term").agg(F.sum("freq").alias("freq"), best.alias("best"))
    return merged.select(key, "term", (-F.col("best.w")).alias("weight"), F.col("best.source").alias("source"), "freq")


def rank_terms(merged: DataFrame, body_stats: DataFrame, count: int, key: str = "id", language: str = "none") -> DataFrame:
    """``(key, term, weight, source, freq, idf, score)``: freq times weight times context IDF; unknown terms drop out.

    Terms stay as they are; their frequency is that of their stem in the language of the index.
    """
    stems = stem_column(merged.withColumn("__term", F.col("term")), "__term", language)
    known = stems.join(body_stats.select(F.col("term").alias("__term"), "df"), "__term").withColumn("idf", scoring.context_idf("df", count))
    return known.withColumn("score", F.col("freq") * F.col("weight") * F.col("idf")).drop("df", "__term")


def build_query(ranked: list[tuple[str, float]], limit: int = TERMS) -> Expr | None:
    """The best terms as boosted alternatives; None without terms."""
    best = sorted(ranked, key=lambda x: (-x[1], x[0]))[:limit]
    return any_of(*[Boost(Term(t), s) for t, s in best]) if best else None


def combine(queries: list[Expr | None], rule_terms: list[str]) -> Expr | None:
    """The files' queries and the rules' terms, boosted, as alternatives."""
    parts = [q for q in queries if q is not None] + [Boost(Term(t), RULE_BOOST) for t in rule_terms]
    return any_of(*parts) if parts else None


def inject(results: DataFrame, includes: list[str], chunks: DataFrame, limit: int) -> DataFrame:
    """Results with the first chunk of each included document before them, unless it is there already; ``limit`` rows in all.

    ``includes`` are few: they come from rules.
    """
    if not includes:
        return results
    spark = results.sparkSession
    wanted = spark.createDataFrame([(d, i) for i, d in enumerate(dict.fromkeys(includes))], "doc_id string, place int")
    first = chunks.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "tree", "place").agg(F.min("id").alias("id"))
    fresh = first.join(results.select("doc_id").distinct(), "doc_id", "left_anti")
    top = fresh.select("id", "doc_id", "tree", F.lit(3.4028234663852886e38).alias("score"), (F.col("place") - len(includes)).cast("long").alias("rank_in"))
    both = top.unionByName(results.select("id", "doc_id", "tree", "score", F.col("rank_in").cast("long").alias("rank_in")))
    return both.orderBy("rank_in", "id").limit(limit)


@dataclass
class Matched:
    """What rules say about a file."""

    terms: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    trees: list[str] | None = None  # None: no rule restricts; an empty list: nothing is left
    overrides: dict = field(default_factory=dict)

"""How characteristic each term is of its document, against the whole collection.

One contingency table of documents and terms serves two scores. Its margins are the terms of a document, the
occurrences and documents of a term, and the grand total:

* correspondence-analysis residuals, ``(observed - expected) / sqrt(expected (1 - row/total) (1 - column/total))``
  with ``expected = row * column / total``: plain arithmetic over the margins (:func:`residuals`);
* ``tf * ln((N + 1) / (df + 1))`` over the same table (:func:`tf_idf`), for results defined by that formula.

Margins of terms join in two ways. Terms that stand in more than one of ``SHARE`` documents are few whatever the
size of the collection: each takes more than N/SHARE of all (document, term) pairs, so there are fewer than SHARE
times the mean number of terms in a document. They are counted, and broadcast if they are at most ``BROADCAST``; if
documents are so long that there are more, their pairs are spread over ``SALTS`` keys a term and shuffled. All other
terms stand in at most N/SHARE documents each, so the shuffle by term that joins them has no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborseek.functions.text import terms
from arborseek.operators.current import current_rows
from arborseek.session import written

SHARE = 1000
BROADCAST = 200_000  # rows (term, df, occurrences) that are broadcast at most, about 10 MB
SALTS = 64
HOT_DOCS = 1000  # a document is hot if it holds more than one of so many rows; so there are fewer than that many


def hot_documents(chunks: DataFrame, least: int = 1000) -> list[str]:
    """Documents with more than ``least`` rows and more than one of HOT_DOCS of all: fewer than HOT_DOCS by definition."""
    counts = chunks.where("doc_id is not null").groupBy("doc_id").count().where(F.col("count") > least)
    large = counts.where(F.col("count") * HOT_DOCS > F.lit(chunks.count())) if counts.limit(1).count() else counts
    return [r["doc_id"] for r in large.collect()]


def term_counts(chunks: DataFrame) -> DataFrame:
    """``(doc_id, term, tf)`` over the current rows, as a written table. Rows without doc_id are left out.

    Each body crosses the network twice: to find the current row of its id, and to meet its document. There the
    terms are counted without a further shuffle. Bodies of hot documents don't meet: their terms are counted where
    they are, and only the counts are shuffled.
    """
    rows = current_rows(chunks, "doc_id", "body").where("doc_id is not null")
    hot = hot_documents(chunks)
    met = (rows.where(~F.col("doc_id").isin(hot)) if hot else rows).repartition("doc_id")
    pairs = met.select("doc_id", F.explode(terms("body")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    if hot:
        own = rows.where(F.col("doc_id").isin(hot)).select("doc_id", F.explode(terms("body")).alias("term"))
        pairs = pairs.unionByName(own.groupBy("doc_id", "term").agg(F.count("*").alias("tf")))
    return written(pairs, "term-counts")


def term_margins(pairs: DataFrame) -> DataFrame:
    """``(term, df, occurrences)``, written: the table is read once for broadcast terms and once for the others."""
    return written(pairs.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences")), "term-margins")


def with_margins(pairs: DataFrame, margins: DataFrame, documents: int) -> DataFrame:
    """Every pair with the margins of its term."""
    common = F.col("df") * SHARE > documents
    hot = margins.where(common)
    if hot.count() <= BROADCAST:
        near = pairs.join(F.broadcast(hot), "term", "left")
        known = near.where("df is not null")
        rest = near.where("df is null").drop("df", "occurrences").join(margins.where(~common), "term")
        return known.unionByName(rest)
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    spread = pairs.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    salted = spread.join(hot.withColumn("__salt", salt), ["term", "__salt"]).drop("__salt")
    # pairs of common terms meet nothing here, but would all be shuffled to one key each: they go first
    rest = spread.join(hot.select("term", salt.alias("__salt")), ["term", "__salt"], "left_anti").drop("__salt")
    return salted.unionByName(rest.join(margins.where(~common), "term"))


def tf_idf(documents: int) -> Column:
    """``tf * ln((N + 1) / (df + 1))``, rounded to 6 decimals."""
    return F.round(F.col("tf") * F.ln(F.lit(documents + 1) / (F.col("df") + 1)), 6)


def residuals(pairs: DataFrame, margins: DataFrame, documents: int) -> DataFrame:
    """``(doc_id, term, score)``: the adjusted residual of every pair, rounded to 6 decimals.

    A term that is all of the collection, or a document that is, has no variance and scores 0.
    """
    rows = pairs.groupBy("doc_id").agg(F.sum("tf").alias("row_total"))
    total = pairs.agg(F.sum("tf")).first()[0] or 0
    table = with_margins(pairs, margins, documents).join(rows, "doc_id")
    expected = F.col("row_total") * F.col("occurrences") / F.lit(float(total or 1))
    variance = expected * (1 - F.col("row_total") / F.lit(float(total or 1))) * (1 - F.col("occurrences") / F.lit(float(total or 1)))
    score = F.when(variance > 0, (F.col("tf") - expected) / F.sqrt(variance)).otherwise(0.0)
    return table.select("doc_id", "term", F.round(score, 6).alias("score"))


def best(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of each document with the highest score, equal scores by term in code-point order.

    The limit is applied before the shuffle too, so a document sends at most ``k`` rows from each partition.
    """
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "term"))
    return scored.withColumn("place", place).where(F.col("place") <= k).drop("place")


def document_total(chunks: DataFrame) -> int:
    return chunks.where("doc_id is not null").select("doc_id").distinct().count()

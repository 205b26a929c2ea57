"""From scored candidates to results: per-tree normalisation, roll-up of siblings, elbow cutoff, limit."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborseek.operators import scoring
from arborseek.operators.index import EXPANDED, among
from arborseek.session import written

CANDIDATES = 50  # candidates a result
POOL, RATIO, THRESHOLD = 500, 0.3, 0.1


@dataclass(frozen=True)
class SearchParams:
    limit: int = 10
    trees: tuple[str, ...] | None = None  # None: all; an empty one: none
    pool: int = POOL
    cutoff_ratio: float = RATIO
    threshold: float = THRESHOLD
    aggregate: bool = True
    local_boost: float = scoring.LOCAL_BOOST
    fuzzy: int = 1

    @property
    def candidate_limit(self) -> int:
        return self.limit * CANDIDATES


def in_trees(rows: DataFrame, trees: tuple[str, ...] | None) -> DataFrame:
    return rows if trees is None else rows.where(F.col("tree").isin(*trees) if trees else F.lit(False))


def candidates(scored: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best rows by raw score, ties by id, with their place ``rank_in`` from 1."""
    top = scored.orderBy(F.desc("score"), "id").limit(limit)
    # at most ``limit`` rows are left, so that one partition numbers them
    return top.withColumn("rank_in", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def boosted(cands: DataFrame, chunks: DataFrame, trees: DataFrame, local_boost: float = scoring.LOCAL_BOOST) -> DataFrame:
    """Candidates with the columns that ranking needs and with heading and locality boosts; the order stays ``rank_in``."""
    slim = chunks.select("id", "parent_id", "depth", "sibling_count")
    rows = scoring.locality_boost(cands.join(slim, "id"), trees, local_boost)
    return rows.withColumn("score", F.col("score") * scoring.heading_boost("depth") * F.col("locality")).drop("locality")


def normalize(rows: DataFrame, tree_count: int | None = None) -> DataFrame:
    """Scores divided by their tree's maximum, ``rank_in`` renumbered by the new score, earlier rank first in ties.

    Nothing changes if one tree at most is searched, or only one has hits. A maximum of 0 or less divides by 1.
    """
    most = F.max("score").over(Window.partitionBy("tree"))
    every = Window.partitionBy()
    hit = F.size(F.collect_set("tree").over(every))
    several = (hit > 1) if tree_count is None else (hit > 1) & F.lit(tree_count > 1)
    scored = rows.withColumn("__several", several).withColumn("__new", F.when(F.col("__several"), F.col("score") / F.when(most > 0, most).otherwise(1.0)).otherwise(F.col("score")))
    place = F.row_number().over(Window.orderBy(F.desc("__new"), "rank_in"))
    return scored.withColumn("rank_in", F.when(F.col("__several"), place).otherwise(F.col("rank_in"))).withColumn("score", F.col("__new")).drop("__several", "__new")


def elbow(rows: DataFrame, ratio: float = RATIO, pool: int = POOL, order: str = "rank_in", reason: bool = False) -> DataFrame:
    """The rows before the first steep drop, in ``order``.

    Row i is cut, with all behind it, if its score is 0 or less; the one behind it if that one's is, or falls below
    ``ratio`` of row i's. At most ``pool`` rows stay; a single row always does. ``reason`` adds ``cutoff``.
    """
    w = Window.orderBy(order)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = rows.withColumn("__n", F.row_number().over(w)).withColumn("__next", F.lead("score").over(w))
    cut = (
        F.when(F.col("__next").isNull(), None)
        .when(F.col("score") <= 0, F.col("__n") - 1)
        .when(F.col("__next") <= 0, F.col("__n"))
        .when(F.col("__next") / F.col("score") < ratio, F.col("__n"))
    )
    found = seen.withColumn("__cut", F.min(cut).over(every)).withColumn("__all", F.count("*").over(every))
    kept = found.where((F.col("__n") <= F.least(F.coalesce("__cut", "__all"), F.lit(pool))) | (F.col("__all") == 1))
    if reason:
        first_bad = F.min(F.when((F.col("score") <= 0) | (F.col("__next") <= 0), F.col("__n"))).over(every)
        why = (
            F.when(F.col("__all") <= 1, "too_few_results")
            .when(F.least(F.coalesce("__cut", "__all"), F.col("__all")) > pool, "max_results_reached")
            .when(F.col("__cut").isNull(), "no_elbow")
            .when(F.col("__bad").isNotNull() & (F.col("__bad") - 1 <= F.col("__cut")), "zero_or_negative")
            .otherwise("ratio_below_threshold")
        )
        kept = found.withColumn("__bad", first_bad).withColumn("cutoff", why).where((F.col("__n") <= F.least(F.coalesce("__cut", "__all"), F.lit(pool))) | (F.col("__all") == 1)).drop("__bad")
    return kept.drop("__n", "__next", "__cut", "__all")


# --- roll-up ------------------------------------------------------------------------------------------------------


def is_ancestor(a: str, b: str) -> bool:
    """Whether chunk ``a`` stands above ``b``: the document above its sections, a slug above those it is a prefix of."""
    doc_a, _, slug_a = a.partition("#")
    doc_b, _, slug_b = b.partition("#")
    return doc_a == doc_b and a != b and bool(slug_b) and (not slug_a or slug_b.startswith(slug_a + "-"))


class _Entry:
    __slots__ = ("id", "parent", "parts", "rank", "siblings", "single")

    def __init__(self, id: str, parent: str | None, siblings: int, rank: int, single: float | None, parts: list | None):
        self.id, self.parent, self.siblings, self.rank, self.single, self.parts = id, parent, siblings, rank, single, parts

    def flat(self) -> list[tuple[str, float]]:
        return self.parts if self.parts is not None else [(self.id, self.single)]

    def score(self) -> float:
        return self.single if self.parts is None else math.sqrt(sum(s * s for _, s in self.parts))


def roll_up(rows: list[tuple], known: dict[str, tuple[str | None, int]], threshold: float) -> list[_Entry]:
    """Results of one document's candidates ``(id, parent_id, sibling_count, score, rank_in)`` in rank order.

    ``known`` has parent and sibling count of the chunks that may become parents.
    """
    results: dict[str, _Entry] = {}

    def enough(count: int, siblings: int) -> bool:
        return count >= threshold * siblings if siblings == 0 else count / siblings >= threshold

    def rise(entry: _Entry) -> None:
        """Put a parent in, and go on to its own parent while enough of its siblings are there."""
        while True:
            results[entry.id] = entry
            near = [e for e in results.values() if e.parent is not None and e.parent == entry.parent]
            if len(near) < 2 or not enough(len(near), entry.siblings) or entry.parent not in known:
                return
            for e in near:
                del results[e.id]
            above, siblings = known[entry.parent]
            entry = _Entry(entry.parent, above, siblings, entry.rank, None, [p for e in near for p in e.flat()])

    for id, parent, siblings, score, rank in rows:
        if id in results or any(is_ancestor(e, id) for e in results):
            continue
        own = _Entry(id, parent, siblings, rank, score, None)
        below = [e for e in results.values() if is_ancestor(id, e.id)]
        if below:
            for e in below:
                del results[e.id]
            rise(_Entry(id, parent, siblings, rank, None, [p for e in below for p in e.flat()]))
            continue
        near = [e for e in results.values() if parent is not None and e.parent == parent]
        if near and siblings > 0 and enough(len(near) + 1, siblings) and parent in known:
            for e in near:
                del results[e.id]
            above, count = known[parent]
            rise(_Entry(parent, above, count, rank, None, [p for e in [*near, own] for p in e.flat()]))
        else:
            results[id] = own
    return list(results.values())


FOLDED_COLUMNS = ("id", "doc_id", "tree", "score", "is_aggregated", "constituents", "rank_in")
FOLDED = "id string, doc_id string, tree string, score double, is_aggregated boolean, constituents array<struct<id:string,score:double>>, rank_in long"


def ancestors(parents: set[str], chunks: DataFrame) -> dict[str, tuple[str | None, int]]:
    """``id: (parent_id, sibling_count)`` of the chunks named and of all above them, one level of the tree a round until none is left.

    Each level has at most as many rows as there are candidates, whatever the documents' size, and is looked up by id;
    an id that was seen is not looked up again, so links in a circle end too.
    """
    known: dict[str, tuple[str | None, int]] = {}
    slim = chunks.select("id", "parent_id", "sibling_count")
    level, seen = set(parents), set()
    while level:
        seen |= level
        rows = slim.where(among("id", list(level))).collect()
        known |= {r["id"]: (r["parent_id"], r["sibling_count"] or 0) for r in rows}
        level = {r["parent_id"] for r in rows if r["parent_id"] is not None} - seen
    return known


def _fold_document(doc: str, rows: list[tuple], known: dict[str, tuple[str | None, int]], threshold: float) -> list[tuple]:
    """Results of one document's candidates ``(id, doc_id, tree, parent_id, sibling_count, score, rank_in)`` as rows of FOLDED."""
    given = [(id, parent, int(siblings or 0), score, rank) for id, _, _, parent, siblings, score, rank in sorted(rows, key=lambda r: r[6])]
    made = roll_up(given, known, threshold)
    return [(e.id, doc, rows[0][2], e.score(), e.parts is not None, [(i, s) for i, s in e.parts] if e.parts is not None else [], e.rank) for e in made]


def fold(cands: DataFrame, chunks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Results after roll-up, renumbered: by score, then by the candidate that completed them.

    Candidates of one document only meet each other. There are as many as the candidate limit: up to EXPANDED, as for
    any page of results, they are rolled up where the query was asked; more are grouped by document and rolled up there.
    """
    spark = chunks.sparkSession
    rows = cands.select("id", "doc_id", "tree", "parent_id", "sibling_count", "score", F.col("rank_in").cast("long").alias("rank_in"))
    few = rows.limit(EXPANDED + 1).collect()
    if len(few) <= EXPANDED:
        known = ancestors({r["parent_id"] for r in few if r["parent_id"] is not None}, chunks)
        docs: dict[str, list[tuple]] = {}
        for r in few:
            docs.setdefault(r["doc_id"], []).append(tuple(r))
        folded = spark.createDataFrame([x for doc, part in docs.items() for x in _fold_document(doc, part, known, threshold)], FOLDED)
    else:
        rows = written(rows, "candidates")
        known = ancestors({r["parent_id"] for r in rows.where("parent_id is not null").select("parent_id").distinct().collect()}, chunks)

        def one(key: tuple, left: pd.DataFrame) -> pd.DataFrame:
            left = left.astype(object).where(left.notna(), None)
            return pd.DataFrame(_fold_document(key[0], [tuple(r) for r in left.itertuples(index=False)], known, threshold), columns=list(FOLDED_COLUMNS))

        folded = rows.groupBy("doc_id").applyInPandas(one, FOLDED)
    return folded.withColumn("rank_in", F.row_number().over(Window.orderBy(F.desc("score"), "rank_in")))


def ranked(scored: DataFrame, chunks: DataFrame, trees: DataFrame, params: SearchParams) -> DataFrame:
    """Candidates with boosted and normalised scores."""
    found = candidates(in_trees(scored, params.trees), params.candidate_limit)
    if params.candidate_limit <= EXPANDED:
        found = F.broadcast(found)
    return normalize(boosted(found, chunks, trees, params.local_boost), len(params.trees) if params.trees else None)


def pipeline(scored: DataFrame, chunks: DataFrame, trees: DataFrame, params: SearchParams) -> DataFrame:
    """``(id, doc_id, tree, score, is_aggregated, constituents, rank_in)`` of the results of matches ``(id, doc_id, tree, score)``."""
    rows = ranked(scored, chunks, trees, params)
    if params.aggregate:
        results = fold(rows, chunks, params.threshold)
    else:
        none = F.array().cast("array<struct<id:string,score:double>>")
        results = rows.select("id", "doc_id", "tree", "score", F.lit(False).alias("is_aggregated"), none.alias("constituents"), F.col("rank_in").cast("long").alias("rank_in"))
    return elbow(results, params.cutoff_ratio, params.pool).where(F.col("rank_in") <= params.limit)


def pipeline_stats(scored: DataFrame, chunks: DataFrame, trees: DataFrame, params: SearchParams) -> DataFrame:
    """One row: how many rows each phase leaves, and why the elbow cut where it did."""
    found = written(ranked(scored, chunks, trees, params), "stats")
    folded = written(fold(found, chunks, params.threshold) if params.aggregate else found, "stats")
    kept = elbow(folded, params.cutoff_ratio, params.pool, reason=True)
    counts = [found.agg(F.count("*").alias("candidates")), folded.agg(F.count("*").alias("aggregated")), kept.agg(F.count("*").alias("after_elbow"), F.first("cutoff").alias("cutoff"))]
    sums = [c.select(*[F.col(x) if x in c.columns else F.lit(None).cast(t).alias(x) for x, t in (("candidates", "long"), ("aggregated", "long"), ("after_elbow", "long"), ("cutoff", "string"))]) for c in counts]
    every = sums[0].unionByName(sums[1]).unionByName(sums[2])
    return every.agg(*[F.max(x).alias(x) for x in ("candidates", "aggregated", "after_elbow", "cutoff")])


def sibling_rss(cands: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One level of roll-up as plain SQL: parents of at least two candidates that make up the threshold of their siblings."""
    grouped = cands.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("n"), F.max("sibling_count").alias("siblings"), F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("score"))
    return grouped.where((F.col("n") >= 2) & (F.col("siblings") > 0) & (F.col("n") / F.col("siblings") >= threshold))

"""From a query expression to a DataFrame ``(id, doc_id, tree, score)``.

The words of all leaves are looked up in the vocabulary together, fuzzy ones with all terms near them. That gives a
table of (term, leaf), with which the postings are read in one scan: where it has at most ``EXPANDED`` rows, its terms
are a filter that reaches the scan and it is broadcast; where it has more, it is joined by whatever join Spark finds fit.
Each row is scored for its leaf, and a single shuffle by id brings flags and scores of all leaves into one row, over
which the boolean tree is plain column arithmetic; alternatives of plain words, of which context queries have dozens,
are one sum. An expression that may hold without any leaf starts from all ids instead.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborseek.functions.stem import stemmer
from arborseek.functions.text import LONGEST, WORD
from arborseek.operators import scoring
from arborseek.operators.index import BOOSTS, EXPANDED, FIELDS, Index, among
from arborseek.query.ast import And, Boost, Expr, Field, Not, Or, Phrase, Term

NAMES = {"title": "hierarchy", "hierarchy": "hierarchy", "tags": "tags", "body": "body", "path": "path"}
_RUN = re.compile(WORD.replace(r"\p{L}\p{N}", r"^\W_"))


class CompileError(ValueError):
    """A query that parses but means nothing: an unknown or nested field, a tree filter of something else than words."""


@dataclass(frozen=True)
class Leaf:
    words: tuple[str, ...]
    fields: tuple[str, ...]
    fuzzy: int  # edit distance; phrases are exact


@dataclass(frozen=True)
class Plan:
    """Match and score as columns over ``hit_i`` and ``score_i``; ``alone`` if it may hold without any leaf.

    ``weights`` has the factor of each leaf where the plan is alternatives of leaves and nothing else.
    """

    match: Column
    score: Column
    alone: bool
    weights: dict[int, float] | None = None


def analyze(text: str, language: str = "none") -> list[str]:
    """Terms of a query text, by the analyzer of the index."""
    word = stemmer(language)
    return [word(w) for w in _RUN.findall(text.lower()) if len(w.encode()) < LONGEST]


def _swaps(word: str) -> set[str]:
    return {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)}


def near(term: Column | str, word: str, distance: int) -> Column:
    """Whether a term is within an edit distance of 0, 1 or 2 of a word, a swap of neighbours counting as one edit.

    Within 2 means two plain edits, or a swap in the word or in the term and one plain edit, or two swaps.
    """
    col = F.col(term) if isinstance(term, str) else term
    if distance == 0:
        return col == word
    if distance > 2:
        raise CompileError("edit distances above 2 aren't supported")
    band = F.abs(F.char_length(col) - len(word)) <= distance
    swaps = sorted(_swaps(word) | {word})
    if distance == 1:
        return band & (F.levenshtein(col, F.lit(word), 1).between(0, 1) | col.isin(swaps))
    twice = sorted({x for w in swaps for x in _swaps(w)} | set(swaps))
    one_off = [F.levenshtein(col, F.lit(w), 1).between(0, 1) for w in swaps]
    turned = F.transform(F.sequence(F.lit(1), F.char_length(col) - 1), lambda i: F.concat(F.substring(col, F.lit(1), i - 1), F.substring(col, i + 1, F.lit(1)), F.substring(col, i, F.lit(1)), F.substring(col, i + 2, F.lit(1 << 20))))
    other = (F.char_length(col) > 1) & F.exists(turned, lambda t: F.levenshtein(t, F.lit(word), 1).between(0, 1))
    # a swap is two plain edits, so what is further than 4 of them is settled at once
    return band & F.levenshtein(col, F.lit(word), 4).between(0, 4) & (F.levenshtein(col, F.lit(word), 2).between(0, 2) | col.isin(twice) | reduce(Column.__or__, one_off) | other)


def expand(index: Index, words: list[str], fields: tuple[str, ...] = ("body", "hierarchy", "path"), distance: int = 1) -> DataFrame:
    """``(word, field, term)``: the vocabulary near each query word, in one scan of it."""
    vocabulary = index.terms.where(F.col("field").isin(*fields))
    wanted = list(dict.fromkeys(words))
    if not wanted:
        return vocabulary.limit(0).select(F.lit("").alias("word"), "field", "term")
    hit = F.array_compact(F.array(*[F.when(near("term", w, distance), F.lit(w)) for w in wanted]))
    return vocabulary.select(F.explode(hit).alias("word"), "field", "term")


class Compiler:
    def __init__(self, index: Index, boosts: dict[str, float] | None = None, fuzzy: int = 0):
        self.index, self.boosts, self.fuzzy = index, boosts or BOOSTS, fuzzy
        self.leaves: list[Leaf] = []

    # --- expression to plan

    def leaf(self, words: list[str], fields: tuple[str, ...]) -> Plan | None:
        if not words:
            return None
        made = Leaf(tuple(words), fields, self.fuzzy if len(words) == 1 else 0)
        if made not in self.leaves:
            self.leaves.append(made)
        i = self.leaves.index(made)
        return Plan(F.col(f"hit_{i}"), F.col(f"score_{i}"), False, {i: 1.0})

    def plan(self, e: Expr, fields: tuple[str, ...] = FIELDS, scoped: bool = False) -> Plan | None:
        """None for what holds no term at all."""
        match e:
            case Term(text):
                return self.leaf(analyze(text, self.index.language), fields)
            case Phrase(words):
                return self.leaf([t for w in words for t in analyze(w, self.index.language)], fields)
            case Boost(child, factor):
                made = self.plan(child, fields, scoped)
                return made and Plan(made.match, made.score * factor, made.alone, made.weights and {i: w * factor for i, w in made.weights.items()})
            case Not(child):
                made = self.plan(child, fields, scoped)
                return made and Plan(~made.match, F.when(~made.match, 1.0).otherwise(0.0), True)
            case Field(name, child):
                if scoped:
                    raise CompileError("a field within a field")
                if name == "tree":
                    return self.trees(child)
                if name not in NAMES:
                    raise CompileError(f"unknown field: {name}")
                return self.plan(child, (NAMES[name],), True)
            case Or(children):
                parts = [p for c in children if (p := self.plan(c, fields, scoped))]
                if not parts:
                    return None
                weights: dict[int, float] | None = {}
                for p in parts:
                    weights = None if weights is None or p.weights is None else {i: weights.get(i, 0.0) + p.weights.get(i, 0.0) for i in weights | p.weights}
                return Plan(_any([p.match for p in parts]), _sum([_where(p) for p in parts]), any(p.alone for p in parts), weights)
            case And(children):
                wanted = [p for c in children if not isinstance(c, Not) and (p := self.plan(c, fields, scoped))]
                barred = [p for c in children if isinstance(c, Not) and (p := self.plan(c.child, fields, scoped))]
                if not wanted and not barred:
                    return None
                match = _all([p.match for p in wanted] + [~p.match for p in barred])
                # a barred part scores nothing, unless it stands within a field or nothing else is asked for
                score = _sum([p.score for p in wanted] + ([F.lit(float(len(barred)))] if barred and (scoped or not wanted) else []))
                if not wanted and not scoped:
                    score = F.lit(1.0)
                return Plan(match, score, all(p.alone for p in wanted))

    def trees(self, e: Expr) -> Plan:
        names = [e] if isinstance(e, Term) else list(e.children) if isinstance(e, Or) else []
        if not names or not all(isinstance(n, Term) for n in names):
            raise CompileError("tree: takes a name or (a OR b)")
        return Plan(F.col("tree").isin([n.text for n in names]), F.lit(0.0), True)

    # --- leaves to rows

    def lookup(self) -> tuple[DataFrame, list[str] | None]:
        """``(field, term, leaf, place, idf)`` of all leaves, with its terms if they are few enough to filter by."""
        index = self.index
        wanted = {(w, leaf.fuzzy) for leaf in self.leaves for w in leaf.words}
        exact = sorted({w for w, d in wanted if not d})
        # what isn't near any word has no parts; exact words alone are a filter that reaches the scan
        fits = among("term", exact) if all(not d for _, d in wanted) else F.lit(True)
        parts = F.array_compact(
            F.array(
                *[
                    F.when(F.col("field").isin(*leaf.fields) & near("term", w, leaf.fuzzy), F.struct(F.lit(i).alias("leaf"), F.lit(k).alias("place")))
                    for i, leaf in enumerate(self.leaves)
                    for k, w in enumerate(leaf.words)
                ]
            )
        )
        idf = scoring.bm25_idf("df", index.count)
        table = index.terms.where(fits).select("field", "term", idf.alias("idf"), F.inline(parts))
        few = table.limit(EXPANDED + 1).collect()
        if len(few) > EXPANDED:
            return table, None
        made = index.chunks.sparkSession.createDataFrame(few, "field string, term string, idf double, leaf int, place int")
        return made, sorted({r["term"] for r in few})

    def hits(self) -> DataFrame | None:
        """``(leaf, id, doc_id, tree, score)``, one row a leaf and field; the postings are read in one scan."""
        if not self.leaves:
            return None
        index = self.index
        table, terms = self.lookup()
        fields = sorted({f for leaf in self.leaves for f in leaf.fields})
        scope = index.postings.where(F.col("field").isin(*fields))
        phrases = [i for i, leaf in enumerate(self.leaves) if len(leaf.words) > 1]
        if terms is not None:
            scope, table = scope.where(among("term", terms)), F.broadcast(table)
        rows = scope.join(table, ["field", "term"])
        boost = _pick("field", {f: self.boosts.get(f, 1.0) for f in fields})
        length = _pick("field", {f: index.averages.get(f) or 1.0 for f in fields})
        if phrases or any(leaf.fuzzy for leaf in self.leaves):
            # terms of one leaf meet: those near one word count once, those of a phrase must stand in a row
            spots = F.collect_list(F.when(F.col("leaf").isin(phrases), F.struct("place", "positions"))) if phrases else F.lit(None)
            whole = rows.repartition("id").groupBy("leaf", "id", "doc_id", "tree", "field", "len").agg(F.max("tf").alias("tf"), F.sum("idf").alias("idf"), spots.alias("spots"))
            if phrases:
                size = _pick("leaf", {i: len(self.leaves[i].words) for i in phrases})
                starts = F.transform("spots", lambda s: F.transform(s["positions"], lambda p: p - s["place"]))
                both = F.aggregate(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.try_element_at(starts, F.lit(1)), lambda a, b: F.array_intersect(a, b))
                tf = F.when(~F.col("leaf").isin(phrases), F.col("tf")).when(F.size("spots") == size, F.size(both)).otherwise(0)
                whole = whole.withColumn("tf", tf.cast("long")).where("tf > 0")
            rows = whole
        fuzzy = [i for i, leaf in enumerate(self.leaves) if leaf.fuzzy]
        score = scoring.bm25("tf", "len", length, F.col("idf"))
        if fuzzy:  # an automaton over the vocabulary scores a constant
            score = F.when(F.col("leaf").isin(fuzzy), F.lit(1.0)).otherwise(score)
        return rows.select("leaf", "id", "doc_id", "tree", (score * boost).alias("score"))

    def run(self, e: Expr | None) -> DataFrame:
        """``(id, doc_id, tree, score)`` of all matches; no expression, or one without terms, matches nothing."""
        plan = self.plan(e) if e is not None else None
        if plan is None:
            return self.index.chunks.select("id", "doc_id", "tree", F.lit(0.0).alias("score")).limit(0)
        hits = self.hits()
        if hits is None:
            return self.index.chunks.select("id", "doc_id", "tree").where(plan.match).select("id", "doc_id", "tree", plan.score.alias("score"))
        if plan.weights is not None:
            weighed = hits.withColumn("score", F.col("score") * _pick("leaf", plan.weights))
            return weighed.groupBy("id").agg(F.first("doc_id").alias("doc_id"), F.first("tree").alias("tree"), F.sum("score").alias("score"))
        flags = [f"hit_{i}" for i in range(len(self.leaves))] + [f"score_{i}" for i in range(len(self.leaves))]
        own = [F.max(F.col("leaf") == i).alias(f"hit_{i}") for i in range(len(self.leaves))]
        own += [F.sum(F.when(F.col("leaf") == i, F.col("score")).otherwise(0.0)).alias(f"score_{i}") for i in range(len(self.leaves))]
        if plan.alone:
            found = hits.groupBy("id").agg(*own)
            rows = self.index.chunks.select("id", "doc_id", "tree").join(found, "id", "left")
            rows = rows.select("id", "doc_id", "tree", *[F.coalesce(F.col(f), F.lit(False) if f.startswith("hit") else F.lit(0.0)).alias(f) for f in flags])
        else:
            rows = hits.groupBy("id").agg(F.first("doc_id").alias("doc_id"), F.first("tree").alias("tree"), *own)
        return rows.where(plan.match).select("id", "doc_id", "tree", plan.score.alias("score"))


def _pick(column: str, values: dict) -> Column:
    made = None
    for k, v in values.items():
        made = F.when(F.col(column) == k, F.lit(float(v))) if made is None else made.when(F.col(column) == k, F.lit(float(v)))
    return made


def _where(p: Plan) -> Column:
    return F.when(p.match, p.score).otherwise(0.0)


def _sum(parts: list[Column]) -> Column:
    made = F.lit(0.0)
    for p in parts:
        made = made + p
    return made


def _any(parts: list[Column]) -> Column:
    made = parts[0]
    for p in parts[1:]:
        made = made | p
    return made


def _all(parts: list[Column]) -> Column:
    made = parts[0]
    for p in parts[1:]:
        made = made & p
    return made

"""Keywords of one text: RAKE, TextRank and YAKE after their papers, and the dispatch by name."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from arborseek.functions.terms import STOP

ALGORITHMS = {"tfidf": "tfidf", "tf-idf": "tfidf", "tf_idf": "tfidf", "rake": "rake", "textrank": "textrank", "text-rank": "textrank", "text_rank": "textrank", "yake": "yake"}
_STOP = frozenset(STOP)
_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s*|\n+")


def algorithm(name: str) -> str:
    try:
        return ALGORITHMS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown keyword algorithm: {name}") from None


def phrases(text: str, longest: int = 3) -> list[tuple[str, ...]]:
    """Runs of words between stopwords and punctuation, cut to ``longest`` words."""
    out = []
    for piece in re.split(r"[^\w\s'’\-]+|\n+", text.lower()):
        run: list[str] = []
        for w in [*_WORD.findall(piece), ""]:
            if w and w not in _STOP and not w.isdigit():
                run.append(w)
            elif run:
                out += [tuple(run[i : i + longest]) for i in range(0, len(run), longest)]
                run = []
    return out


def rake(text: str) -> list[tuple[str, float]]:
    """Phrases scored by the sum of their words' degree over frequency."""
    found = phrases(text)
    freq, degree = Counter(), Counter()
    for p in found:
        for w in p:
            freq[w] += 1
            degree[w] += len(p)
    return _ranked({" ".join(p): sum(degree[w] / freq[w] for w in p) for p in found})


def textrank(text: str, window: int = 2, damping: float = 0.85, tolerance: float = 5e-5, rounds: int = 200) -> list[tuple[str, float]]:
    """Words ranked by power iteration over the graph of neighbours within ``window``, added up over phrases."""
    words = [w for w in _WORD.findall(text.lower()) if w not in _STOP and not w.isdigit()]
    edges: Counter[tuple[int, int]] = Counter()
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    places = [names[w] for w in words]
    for gap in range(1, window + 1):
        edges.update((a, b) for a, b in zip(places, places[gap:], strict=False) if a != b)
    if not edges:
        return _ranked(dict.fromkeys(words, 1.0))
    ends = np.array(list(edges), np.int64)
    weight = np.array(list(edges.values()), float)
    source, target, weight = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]]), np.concatenate([weight, weight])
    totals = np.bincount(source, weight, len(names))
    flow = weight / totals[source]
    ranks = np.ones(len(names))
    for _ in range(rounds):
        new = (1 - damping) + damping * np.bincount(target, flow * ranks[source], len(names))
        moved = np.abs(new - ranks).max()
        ranks = new
        if moved < tolerance:
            break
    rank = dict(zip(names, ranks.tolist(), strict=True))
    scores = dict(rank)
    for p in phrases(text):
        if len(p) > 1:
            scores[" ".join(p)] = sum(rank.get(w, 0.0) for w in p)
    return _ranked(scores)


def yake(text: str, longest: int = 3) -> list[tuple[str, float]]:
    """Phrases by casing, position, frequency, relatedness and spread over sentences; turned so that greater is better."""
    sentences = [_WORD.findall(s) for s in _SENTENCE.split(text) if s.strip()]
    tf, upper, left, right, places = Counter(), Counter(), defaultdict(set), defaultdict(set), defaultdict(list)
    for n, words in enumerate(sentences):
        for i, raw in enumerate(words):
            w = raw.lower()
            tf[w] += 1
            places[w].append(n)
            upper[w] += (raw[0].isupper() and i > 0) or (len(raw) > 1 and raw.isupper())
            if i:
                left[w].add(words[i - 1].lower())
            if i + 1 < len(words):
                right[w].add(words[i + 1].lower())
    if not tf:
        return []
    mean = sum(tf.values()) / len(tf)
    spread = math.sqrt(sum((v - mean) ** 2 for v in tf.values()) / len(tf))
    most = max(tf.values())

    def word_score(w: str) -> float:
        case = upper[w] / (1 + math.log(tf[w]))
        at = sorted(places[w])
        position = math.log(math.log(3 + at[len(at) // 2]))
        norm = tf[w] / (mean + spread)
        related = 1 + (len(left[w]) / tf[w] + len(right[w]) / tf[w]) * tf[w] / most
        different = len(set(at)) / max(1, len(sentences))
        return related * position / (case + norm / related + different / related)

    times = Counter(p[i : i + n] for p in phrases(text, longest) for n in range(1, len(p) + 1) for i in range(len(p) - n + 1))
    scores: dict[str, float] = {}
    for part, n in times.items():
        known = [word_score(w) for w in part if w in tf]
        if len(known) == len(part):
            scores[" ".join(part)] = math.prod(known) / (n * (1 + sum(known)))
    return _ranked({k: 1 / (s + 1e-4) for k, s in scores.items()})


def _ranked(scores: dict[str, float]) -> list[tuple[str, float]]:
    # rounded, so that sums of the same numbers in another order rank alike
    return sorted(((t, round(s, 9)) for t, s in scores.items()), key=lambda x: (-x[1], x[0]))


EXTRACTORS: dict[str, Callable[[str], list[tuple[str, float]]]] = {"rake": rake, "textrank": textrank, "yake": yake}


def keywords(rows: DataFrame, name: str, key: str = "id", column: str = "body", limit: int = 50) -> DataFrame:
    """``(key, term, score, source, algorithm)``: the best ``limit`` keywords of each text; null and empty texts have none."""
    name = algorithm(name)
    extract = EXTRACTORS[name]

    def run(batches):
        for b in batches:
            out = [(k, t, float(s), "body", name) for k, text in zip(b[key], b[column], strict=True) if text for t, s in extract(text)[:limit]]
            yield pd.DataFrame(out, columns=[key, "term", "score", "source", "algorithm"])

    return rows.select(key, column).mapInPandas(run, f"{key} string, term string, score double, source string, algorithm string")

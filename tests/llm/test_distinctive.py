import math
from collections import Counter, defaultdict
from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from arborseek.llm import distinctive as d

CHUNKS = "id string, doc_id string, mtime timestamp, body string, tags array<string>, hierarchy array<string>, term string, score double"


def chunks(spark, docs):
    rows = [(f"{doc}#{i}", doc, D(2025, 1, 1), body, None, None, "clash", 1.0) for doc, bodies in docs.items() for i, body in enumerate(bodies)]
    rows += rows[:3] + [("n", None, None, "nobody", None, None, None, None)]
    rows += [(rows[0][0], rows[0][1], D(2024, 1, 1), "stale stale stale", None, None, "", 0.0)]
    return spark.createDataFrame(rows, CHUNKS)


def brute(docs):
    tf = {doc: Counter(w for b in bodies if b for w in b.lower().split()) for doc, bodies in docs.items()}
    df = Counter(t for c in tf.values() for t in c)
    return tf, df


DOCS = {"a": ["x y x", "z"], "b": ["x q q q", None], "c": [""], "d": ["y y y w", "tie1 tie2 tie3"], "e": ["tie3 tie2 tie1"], "f": ["x " * 50]}


@pytest.mark.parametrize(("share", "most"), [(1000, 10**6), (2, 10**6), (1000, 0), (2, 1)])
def test_scores(spark, monkeypatch, share, most):
    monkeypatch.setattr(d, "SHARE", share)
    monkeypatch.setattr(d, "BROADCAST", most)
    tf, df = brute(DOCS)
    table = chunks(spark, DOCS)
    n = d.document_total(table)
    assert n == len(DOCS)
    pairs = d.term_counts(table)
    margins = d.term_margins(pairs)
    got = {(r["doc_id"], r["term"]): r["score"] for r in d.with_margins(pairs, margins, n).withColumn("score", d.tf_idf(n)).collect()}
    want = {(doc, t): tf[doc][t] * math.log((n + 1) / (df[t] + 1)) for doc in tf for t in tf[doc]}
    assert got == pytest.approx(want, abs=1e-6)
    top = defaultdict(list)
    for r in d.best(d.with_margins(pairs, margins.where("df >= 2"), n).withColumn("score", d.tf_idf(n)), 3).collect():
        top[r["doc_id"]].append(r["term"])
    assert {k: sorted(v) for k, v in top.items()} == {"a": ["x", "y"], "b": ["x"], "d": ["tie1", "tie2", "y"], "e": ["tie1", "tie2", "tie3"], "f": ["x"]}
    total = sum(sum(c.values()) for c in tf.values())
    occ = Counter()
    for c in tf.values():
        occ.update(c)
    want = {}
    for doc, c in tf.items():
        row = sum(c.values())
        for t, o in c.items():
            e = row * occ[t] / total
            want[doc, t] = (o - e) / math.sqrt(e * (1 - row / total) * (1 - occ[t] / total))
    got = {(r["doc_id"], r["term"]): r["score"] for r in d.residuals(pairs, margins, n).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_hot_document_is_not_gathered(spark, monkeypatch):
    docs = {"hot": [f"w{i % 5} common" for i in range(60)], "cold": ["w1"]}
    table = chunks(spark, docs)
    monkeypatch.setattr(d, "HOT_DOCS", 20)
    assert d.hot_documents(table) == []
    assert d.hot_documents(table, least=5) == ["hot"]
    monkeypatch.setattr(d.hot_documents, "__defaults__", (5,))
    tf, _ = brute(docs)
    got = {(r["doc_id"], r["term"]): r["tf"] for r in d.term_counts(table).collect()}
    assert got == {(doc, t): n for doc, c in tf.items() for t, n in c.items()}


def test_empty_and_single(spark):
    none = chunks(spark, {"a": ["x"]}).where(F.lit(False))
    pairs = d.term_counts(none)
    assert d.with_margins(pairs, d.term_margins(pairs), 0).count() == 0
    assert d.residuals(pairs, d.term_margins(pairs), 0).count() == 0
    one = d.term_counts(chunks(spark, {"a": ["x x"]}))
    assert [r["score"] for r in d.residuals(one, d.term_margins(one), 1).collect()] == [0.0]

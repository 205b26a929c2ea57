import math

import pytest

from arborseek.operators import ranking as r

D = "local:test.md"


def run(rows, known, threshold=0.5):
    made = [(i, p, n, s, k + 1) for k, (i, p, s, n) in enumerate(rows)]
    by_doc = {}
    for row in made:
        by_doc.setdefault(row[0].partition("#")[0], []).append(row)
    out = [e for part in by_doc.values() for e in r.roll_up(part, known, threshold)]
    return [(e.id, len(e.parts) if e.parts is not None else 0) for e in sorted(out, key=lambda e: (-e.score(), e.rank))]


DOC = {D: (None, 1)}
SECTIONS = DOC | {f"{D}#s1": (D, 2), f"{D}#s2": (D, 2)}


@pytest.mark.parametrize(
    ("rows", "known", "expected"),
    [
        ([(D, None, 10, 1), (f"{D}#s1", D, 5, 2), (f"{D}#s2", D, 4, 2), ("local:other.md", None, 3, 1)], DOC, [(D, 0), ("local:other.md", 0)]),
        ([(f"{D}#s1", D, 5, 2), (f"{D}#s2", D, 4, 2)], DOC, [(D, 2)]),
        ([(f"{D}#s1", D, 5, 5), (f"{D}#s2", D, 4, 5)], DOC, [(f"{D}#s1", 0), (f"{D}#s2", 0)]),
        ([("a#s1", "a", 10, 2), ("b#s1", "b", 9, 2), ("a#s2", "a", 8, 2), ("b#s2", "b", 7, 2)], {"a": (None, 1), "b": (None, 1)}, [("a", 2), ("b", 2)]),
        ([(f"{D}#s1-a", f"{D}#s1", 10, 2), (f"{D}#s1-b", f"{D}#s1", 9, 2), (f"{D}#s2-a", f"{D}#s2", 8, 2), (f"{D}#s2-b", f"{D}#s2", 7, 2)], SECTIONS, [(D, 4)]),
        ([(f"{D}#s1", D, 5, 2), (f"{D}#s2", D, 4, 2)], {}, [(f"{D}#s1", 0), (f"{D}#s2", 0)]),
        ([(f"{D}#child-a", D, 10, 3), (f"{D}#child-b", D, 9, 3), (D, None, 5, 1)], {}, [(D, 2)]),
        ([(f"{D}#s1-a", f"{D}#s1", 10, 3), (f"{D}#s1-b", f"{D}#s1", 9, 3), (f"{D}#s1", D, 5, 2), (D, None, 2, 1)], SECTIONS, [(D, 2)]),
        ([(f"{D}#s1", D, 5, 2), (f"{D}#s1", D, 5, 2)], DOC, [(f"{D}#s1", 0)]),
    ],
)
def test_roll_up(rows, known, expected):
    assert run(rows, known) == expected


def test_root_sum_square():
    (e,) = r.roll_up([(f"{D}#a", D, 2, 8.0, 1), (f"{D}#b", D, 2, 6.0, 2)], DOC, 0.5)
    assert e.score() == pytest.approx(10.0) and math.isclose(sum(s for _, s in e.parts), 14)


@pytest.mark.parametrize(
    ("scores", "ratio", "pool", "kept"),
    [
        ([8, 7.5, 7, 3.2, 3, 2.8, 0.9], 0.5, 20, 3), ([], 0.5, 20, 0), ([5], 0.5, 20, 1), ([5, 4.5], 0.5, 20, 2), ([5, 2], 0.5, 20, 1), ([10, 9.5, 9, 8.5, 8, 7.5, 7], 0.5, 3, 3),
        ([10, 9, 2, 1.5, 1], 0.5, 10, 2), ([10, 9, 8, 7, 6, 1], 0.5, 3, 3), ([5, 4, 0, 3], 0.5, 20, 2), ([5, 4, -1, 3], 0.5, 20, 2), ([0, 5, 4], 0.5, 20, 0), ([10, 1, 0.9, 0.8], 0.5, 20, 1),
        ([10, 5, 2.5], 0.5, 20, 3), ([10, 4.9, 2], 0.5, 20, 1), ([10, 8, 6, 4], 0.7, 20, 3), ([10, 8, 6, 4], 0.9, 20, 1),
    ],
)
def test_elbow(spark, scores, ratio, pool, kept):
    df = spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "rank_in int, score double")
    assert [x["rank_in"] for x in r.elbow(df, ratio, pool).orderBy("rank_in").collect()] == list(range(kept))


@pytest.mark.parametrize(
    ("rows", "count", "expected"),
    [
        ([("a", 100), ("a", 50)], 1, [100, 50]),
        ([("a", 4500), ("a", 3000), ("b", 800), ("b", 600)], 2, [1.0, 1.0, 0.75, 2 / 3]),
        ([("a", 100), ("a", 50)], 2, [100, 50]),
        ([("a", 100), ("a", 0), ("b", 50)], 2, [1.0, 1.0, 0.0]),
        ([("a", 1000), ("b", 500), ("c", 100)], None, [1.0, 1.0, 1.0]),
        ([("a", -5), ("b", 10)], 2, [1.0, -5.0]),
    ],
)
def test_normalize(spark, rows, count, expected):
    df = spark.createDataFrame([(i + 1, t, float(s)) for i, (t, s) in enumerate(rows)], "rank_in int, tree string, score double")
    got = [x["score"] for x in r.normalize(df, count).orderBy("rank_in").collect()]
    assert got == pytest.approx(expected)


CANDS = "id string, doc_id string, tree string, parent_id string, sibling_count int, score double, rank_in int"
NODES = "id string, parent_id string, sibling_count int"


@pytest.mark.parametrize("expanded", [20_000, 0])
def test_fold_here_and_there(spark, monkeypatch, expanded):
    monkeypatch.setattr(r, "EXPANDED", expanded)
    # a chain of twelve levels, the last with two children; a circle; a parent that is missing
    chain = [("d", None, 1), *((f"d#{i}", "d" if i == 0 else f"d#{i - 1}", 2) for i in range(12)), ("d#a", "d#11", 2), ("d#b", "d#11", 2)]
    nodes = spark.createDataFrame([*chain, ("x#1", "x#2", 2), ("x#2", "x#1", 2)], NODES)
    rows = [("d#a", "d", "t", "d#11", 2, 3.0, 1), ("d#b", "d", "t", "d#11", 2, 4.0, 2), ("x#1", "x", "t", "x#2", 2, 2.0, 3), ("y#1", "y", None, "y", None, 1.0, 4), ("y#2", "y", None, "y", 2, 0.5, 5)]
    got = [(x["id"], x["score"], len(x["constituents"]), x["rank_in"]) for x in r.fold(spark.createDataFrame(rows, CANDS), nodes, 0.5).orderBy("rank_in").collect()]
    assert got == [("d#11", 5.0, 2, 1), ("x#1", 2.0, 0, 2), ("y#1", 1.0, 0, 3), ("y#2", 0.5, 0, 4)]
    assert set(r.ancestors({"d#11", "x#2", "y"}, nodes)) == {i for i, _, _ in chain[:13]} | {"x#1", "x#2"}
    assert r.fold(spark.createDataFrame([], CANDS), nodes).count() == 0

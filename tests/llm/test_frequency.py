import random
from collections import Counter
from datetime import datetime as D

from arborseek.llm import frequency as f

CHUNKS = "id string, mtime timestamp, body string, tags array<string>, hierarchy array<string>, count long, suffix string"


def brute(records, longest):
    n, r = Counter(), Counter()
    for field, words in records:
        words = [w for w in words or () if w is not None]
        grams = [(field, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
        n.update(grams)
        r.update(set(grams))
    return {(a, b): (n[a, b], r[a, b]) for a, b in n if a is not None}


def counted(spark, records, longest, **kw):
    df = spark.createDataFrame(records, "field_name string, terms array<string>")
    rows = f.ngram_counts(df, longest, **kw).collect()
    got = {(x["field_name"], tuple(x["ngram"].split(f.SEP))): (x["occurrences"], x["records"]) for x in rows}
    assert len(got) == len(rows) and all(x["n"] == len(x["ngram"].split(f.SEP)) for x in rows)
    return got


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = ["a", "ab", "b", "a b", "é", "z"]
    records = [(rng.choice(["body", "tags"]), [rng.choice(words) for _ in range(rng.randrange(0, 9))]) for _ in range(120)]
    records += [("body", None), ("body", []), (None, ["a"]), ("body", ["a", None, "b"]), ("body", ["a"] * 50), records[0], records[0]]
    for longest in (1, 2, 3):
        assert counted(spark, records, longest) == brute(records, longest)
    assert counted(spark, records, 3, salts=1) == brute(records, 3)
    assert counted(spark, [], 2) == {}


def test_hot_term(spark):
    records = [("body", ["hot", str(i % 7)]) for i in range(600)] + [("body", ["cold"])]
    assert counted(spark, records, 2) == brute(records, 2)


def test_chunks(spark):
    t = D(2025, 1, 1)
    rows = [
        ("a", None, "old OLD", ["X"], None, 1, ""),
        ("a", t, "New, new! naïve_x2", [" Doc ", "docs", "", None, "DOC"], None, 1, ""),
        ("a", t, "New, new! naïve_x2", [" Doc ", "docs", "", None, "DOC"], None, 1, ""),
        ("b", None, None, None, None, 2, ""),
        ("c", None, "", [], None, 2, ""),
        ("d", None, "x" * 40 + " " + "é" * 19 + " new", ["a b"], None, 2, ""),
        (None, t, "nobody", ["n"], None, 2, ""),
    ]
    df = spark.createDataFrame(rows, CHUNKS)
    counts = f.ngram_counts(f.chunk_records(df))
    got = {(r["field_name"], r["ngram"]): (r["occurrences"], r["records"]) for r in counts.collect()}
    assert got == {("body", "new"): (3, 2), ("body", "naïve"): (1, 1), ("body", "x2"): (1, 1), ("body", "é" * 19): (1, 1), ("tags", "doc"): (2, 1), ("tags", "docs"): (1, 1), ("tags", "a b"): (1, 1)}
    assert f.current_total(df) == 4
    marks = {r["ngram"]: r["verdict"] for r in f.verdicts(counts, 4, fewest=2).collect()}
    assert marks["new"] == "common" and marks["doc"] == "rare"

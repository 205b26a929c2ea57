from collections import Counter

import pytest
from pyspark.sql import functions as F

from arborseek.functions.terms import context_words, path_words
from arborseek.operators import context as c
from arborseek.operators import highlight as h
from arborseek.operators import keywords as k
from arborseek.operators.current import current_rows

TEXT = "Linear systems of inequations. Minimal set of solutions of linear systems. Linear systems are solved over natural numbers. Criteria of compatibility of linear systems."


def test_rake_by_hand():
    got = dict(k.rake("deep red wine, red wine and wine"))
    # red: degree 3 + 2 over 2, wine: 3 + 2 + 1 over 3, deep: 3 over 1
    assert got == pytest.approx({"deep red wine": 3 + 2.5 + 2, "red wine": 4.5, "wine": 2.0})


def test_textrank_fixed_point():
    rank = dict(k.textrank("alpha beta gamma alpha delta", window=1))
    graph = Counter({("alpha", "beta"): 1, ("beta", "gamma"): 1, ("gamma", "alpha"): 1, ("alpha", "delta"): 1})
    near = {w: {b if a == w else a: n for (a, b), n in graph.items() if w in (a, b)} for w in ("alpha", "beta", "gamma", "delta")}
    for w, c_ in near.items():
        assert rank[w] == pytest.approx(0.15 + 0.85 * sum(n / sum(near[v].values()) * rank[v] for v, n in c_.items()), abs=1e-3)


@pytest.mark.parametrize("name", ["rake", "textrank", "yake"])
def test_extractors(spark, name):
    ranked = k.EXTRACTORS[name](TEXT)
    assert ranked == sorted(ranked, key=lambda x: (-x[1], x[0])) and any("linear" in t for t, _ in ranked[:5])
    assert k.EXTRACTORS[name]("") == [] and k.EXTRACTORS[name]("the of and") == []
    df = spark.createDataFrame([("a", TEXT, 1.0), ("b", None, 1.0), ("c", "", 1.0)], "id string, body string, score double")
    rows = k.keywords(df, name, limit=3).collect()
    assert [(r["term"], r["algorithm"]) for r in rows] == [(t, name) for t, _ in ranked[:3]]


def test_names():
    assert k.algorithm("TF-IDF") == "tfidf" and k.algorithm("textrank") == "textrank"
    with pytest.raises(ValueError):
        k.algorithm("bert")


def test_terms(spark):
    df = spark.createDataFrame([("a", "The Rust-Lang parser, naïve_x parsers! abc self 1234", "src/api-v2/request_handler.rs", "# Parser *Design*\n\nParser text body.\n")], "id string, body string, path string, content string")
    assert df.select(context_words("body")).first()[0] == ["rust", "lang", "parser", "naïve", "parsers", "1234"]
    assert [(r["term"], r["weight"]) for r in df.select(path_words("path")).first()[0]] == [("request", 4.0), ("handler", 4.0)]
    md = {(r["term"], r["source"]): (r["weight"], r["freq"]) for r in c.markdown_terms(df).collect()}
    assert md == {("parser", "md:h1"): (3.0, 1), ("design", "md:h1"): (3.0, 1), ("parser", "body"): (1.0, 1), ("text", "body"): (1.0, 1), ("body", "body"): (1.0, 1)}
    merged = {r["term"]: (r["weight"], r["source"], r["freq"]) for r in c.merge_terms(c.markdown_terms(df)).collect()}
    assert merged["parser"] == (3.0, "md:h1", 2)


def test_ranges(spark):
    assert h.byte_ranges("é fox-fox foxes", {"fox"}) == [(3, 3), (7, 3)]
    df = spark.createDataFrame([("a", 0, 5), ("a", 3, 8), ("a", 10, 15), ("a", 20, 25), ("b", 0, 5), ("b", 5, 10), ("c", 4, 4), ("c", None, 3)], "id string, start long, end long")
    assert sorted(tuple(r[x] for x in ("id", "start", "end")) for r in h.merge_ranges(df).collect()) == [("a", 0, 8), ("a", 10, 15), ("a", 20, 25), ("b", 0, 10)]
    text = spark.createDataFrame([("a", "one\nthe Fox\n\nend"), ("b", None), ("c", "")], "id string, body string")
    assert [tuple(r) for r in h.matching_lines(text, ["fox"]).collect()] == [("a", 2, "the Fox")]
    spans = sorted((r["line"], r["start"], r["end"]) for r in h.lines(text).where("id = 'a'").collect())
    assert spans == [(1, 0, 3), (2, 4, 11), (3, 12, 12), (4, 13, 16)]
    moved = text.limit(1).select(h.shift_ranges(F.array(F.struct(F.lit(2).alias("offset"), F.lit(3).alias("length"))), F.lit(4), F.lit(9)).alias("r")).first()["r"]
    assert [(r["offset"], r["length"]) for r in moved] == [(6, 3)]


def test_snippets():
    long = "filler " * 60 + "a fox and another fox here " + "filler " * 60 + "fox"
    got = h.snippet_of(long, {"fox": 1.0})
    assert got.count("<b>fox</b>") == 2 and len(got.replace("<b>", "").replace("</b>", "")) <= h.SNIPPET
    assert h.snippet_of("none", {"fox": 1.0}) == ""


@pytest.mark.parametrize("most", [200_000, 1])
def test_current_rows(spark, monkeypatch, most):
    from datetime import datetime as D

    from arborseek.operators import current

    monkeypatch.setattr(current, "REPEATED", most)

    t = [D(2025, 1, i) for i in (1, 2)]
    rows = [("a", t[0], "x", None, None), ("a", t[1], None, ["q"], None), ("a", t[1], None, ["q"], None), ("b", None, "y", None, None), ("c", None, "z1", None, None), ("c", None, "z2", None, None), (None, t[0], "n", None, None)]
    df = spark.createDataFrame(rows, "id string, mtime timestamp, body string, tags array<string>, hierarchy array<string>")
    got = {r["id"]: r["body"] for r in current_rows(df, "body", "tags").collect()}
    assert set(got) == {"a", "b", "c"} and got["a"] is None and got["b"] == "y"
    assert got == {r["id"]: r["body"] for r in current_rows(df.orderBy(F.desc("body")), "body").collect()}
    assert current_rows(df.limit(0), "body").count() == 0

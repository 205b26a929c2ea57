import json
import os
from datetime import datetime as D

import pytest

from arborseek.api import Engine
from arborseek.cli import main, parser, show
from arborseek.config import Config, Rule, Tree
from arborseek.operators.changes import Ledger
from arborseek.operators.highlight import lines_of_ranges
from arborseek.query.ast import leaf_terms
from arborseek.query.compiler import CompileError, Compiler
from arborseek.query.parser import parse
from arborseek.streaming.ingest import chunk_stream, ingest

FILES = {
    "local/rust.md": "---\ntags: [rust, programming]\n---\n# Getting Started\n\nRust is a systems programming language focused on safety.\n\n## Memory\n\nOwnership keeps memory safe without a collector.\n\n## Threads\n\nOwnership also helps threads share memory.\n",
    "local/async.md": "# Async Programming\n\nAsynchronous programming in Rust uses futures and the async syntax.\n",
    "local/fox.txt": "The quick brown fox jumps over the lazy dog.",
    "shared/errors.md": "# Error Handling\n\nRust error handling uses Result and Option types for safety.\n",
    "local/bad.md": b"\xff\xfe",
}



@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("trees")
    for name, text in FILES.items():
        (base / name).parent.mkdir(exist_ok=True)
        (base / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    rules = [Rule(["*.py"], ["ownership"], None, ["shared:errors.md"])]
    config = Config(trees=[Tree("local", str(base / "local")), Tree("shared", str(base / "shared"), True)], rules=rules)
    made = Engine(spark, str(base / "index"), config)
    assert made.status() == "missing"
    stats = made.index()
    assert (stats["added"], stats["errors"]) == (5, 1)
    return made


def ids(df):
    return [r["id"] for r in df.collect()]


def test_search(engine):
    assert engine.count() == sum(r["chunks"] for r in engine.list_docs().collect())
    found = engine.search("rust", aggregate=False, cutoff_ratio=0.0)
    assert {i.partition("#")[0] for i in ids(found)} == {"local:rust.md", "local:async.md", "shared:errors.md"}
    assert all("shared" in i for i in ids(engine.search("rust", trees=["shared"])))
    assert ids(engine.search("")) == [] and ids(engine.search("python")) == [] and ids(engine.search("rust", trees=[])) == []
    (fox,) = engine.search("qiuck").collect()  # a swap away
    assert fox["snippet"].count("<b>quick</b>") == 1 and [(r["offset"], r["length"]) for r in fox["ranges"]] == [(4, 5)]
    (phrase,) = engine.search('"systems programming"', aggregate=False).collect()
    assert phrase["body"].count("systems programming") == 1
    assert ids(engine.search("programs", fuzzy=0)) == ids(engine.search("programming", fuzzy=0))  # stems
    with pytest.raises(CompileError):
        engine.search("nofield:x")
    with pytest.raises(CompileError):
        engine.search("tree:(a b)")


def test_roll_up_and_explain(engine):
    (r,) = engine.search("ownership", cutoff_ratio=0.0).collect()
    assert r["is_aggregated"] and len(r["constituents"]) == 2 and "#" in r["id"]
    told = engine.explain("ownership")
    assert told["candidates"] == 2 and told["aggregated"] == 1 and "Term('ownership')" in told["tree"]
    assert {(x["term"], x["field"]) for x in engine.details("ownership", aggregate=False).collect()} == {("ownership", "body")}
    assert json.loads(engine.to_json("lazy", engine.search("lazy")))["queries"][0]["total_matches"] == 1


def test_ranges_of_rolled_up_results(engine):
    (r,) = engine.search("ownership", cutoff_ratio=0.0).collect()
    text = FILES["local/rust.md"]
    assert r["body"] == text[text.index("Rust is") :] and r["matches"] == 2
    raw = r["body"].encode()
    assert [raw[x["offset"] : x["offset"] + x["length"]] for x in r["ranges"]] == [b"Ownership", b"Ownership"]
    assert [n for n, _ in lines_of_ranges(r["body"], [(x["offset"], x["length"]) for x in r["ranges"]])] == [5, 9]


def test_plans_read_what_they_need(engine):
    index = engine._load()
    plan = Compiler(index, fuzzy=1).run(parse('rust async "systems programming" -lazy body:futures'))
    text = plan._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in text.splitlines() if "FileScan" in x]
    assert len(scans) == 1 and "EqualTo(term," in scans[0].replace(" ", "")
    shown = engine.search("rust", details=False, aggregate=False)
    assert "Exchange hashpartitioning" not in shown._jdf.queryExecution().executedPlan().toString()


def test_distance_two_and_matched_terms(engine):
    assert ids(engine.search("wonersihp", fuzzy=2, aggregate=False)) and not ids(engine.search("wonersihp", fuzzy=1, aggregate=False))
    with pytest.raises(CompileError):
        engine.search("rust", fuzzy=3)
    rows = engine.details("ownership", aggregate=False).collect()
    assert {(r["word"], r["field"], r["tf"], r["field_score"], r["base_score"]) for r in rows} == {("ownership", "body", 1, 1.0, 1.0)}


def test_like_this_and_context(engine):
    like = ids(engine.like_this("local:rust.md#memory", aggregate=False, cutoff_ratio=0.0))
    assert like[0] == "local:rust.md#threads" and "local:rust.md#memory" not in like
    with pytest.raises(KeyError):
        engine.like_this("local:none.md")
    assert ids(engine.like_this(fields={"body": "futures and async syntax"}, aggregate=False))[0].startswith("local:async.md")
    assert engine.explain_like_this("local:rust.md#memory").count() > 0
    for algorithm in ("tfidf", "textrank", "rake", "yake"):
        rows = ids(engine.context([("/x/ownership.py", "Memory ownership and threads. Safe memory.")], algorithm, cutoff_ratio=0.0))
        assert rows[0] == "shared:errors.md" and any(i.startswith("local:rust.md") for i in rows)
    own = engine.config.trees[0].path + "/rust.md"
    assert not any(i.startswith("local:rust.md") for i in ids(engine.context([(own, "ownership memory threads")])))


def test_get_and_lists(engine):
    assert len(ids(engine.get("local:rust.md"))) == 4 and ids(engine.get("local:fox.txt")) == ["local:fox.txt"]
    with pytest.raises(KeyError):
        engine.get("local:none.md#x")
    assert ids(engine.list_chunks("shared")) == ["shared:errors.md", "shared:errors.md#error-handling"]


def test_update(engine):
    from pathlib import Path

    base = Path(engine.config.trees[0].path)
    (base / "bad.md").write_text("# Mended\n\nzebra")
    (base / "fox.txt").unlink()
    assert engine.status() == "stale"
    stats = engine.index()
    assert (stats["added"], stats["removed"], stats["errors"]) == (1, 1, 0)
    assert ids(engine.search("zebra", aggregate=False)) == ["local:bad.md#mended"] and ids(engine.search("quick")) == []
    assert engine.status() == "current" and engine.index()["added"] == 0


def same(one, other):
    assert one.count == other.count
    for name in ("terms", "stats"):
        assert {tuple(r) for r in getattr(one, name).collect()} == {tuple(r) for r in getattr(other, name).collect()}
    for name in ("chunks", "postings"):
        cols = ("id", "body") if name == "chunks" else ("field", "term", "id", "tf", "len")
        assert sorted(map(str, getattr(one, name).select(*cols).collect())) == sorted(map(str, getattr(other, name).select(*cols).collect()))


def test_updates_write_what_changed_and_equal_a_rebuild(spark, tmp_path):
    base = tmp_path / "docs"
    base.mkdir()
    for i in range(120):
        (base / f"d{i}.md").write_text(f"# Title {i}\n\n" + f"common words and w{i} " * 40 + "\n\n## Part\n\nmore\n")
    config = Config(trees=[Tree("t", str(base))])
    engine = Engine(spark, str(tmp_path / "index"), config)
    assert engine.index()["added"] == 120
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "index").rglob("*.parquet"))
    first = size()

    def put(name, data, k):
        (base / name).write_bytes(data)
        os.utime(base / name, (k * 1000, k * 1000))  # times count in whole seconds

    steps = [
        (lambda: put("d7.md", b"# Other\n\nzebra\n", 1), {"added": 0, "modified": 1, "removed": 0, "errors": 0}),
        (lambda: ((base / "d8.md").unlink(), put("new [1].md", b"# New\n\nyak", 2)), {"added": 1, "modified": 0, "removed": 1, "errors": 0}),
        (lambda: put("d9.md", b"\xff\xfe\x00\x01", 3), {"added": 0, "modified": 1, "removed": 0, "errors": 1}),
    ]
    for change, told in steps:
        change()
        stats = engine.index()
        assert {k: stats[k] for k in told} == told
    assert engine.index()["added"] == 1  # what couldn't be read is tried again
    assert size() - first < first / 2  # no update wrote the whole anew
    whole = Engine(spark, str(tmp_path / "whole"), config)
    whole.index()
    same(engine._load(), whole._load())
    assert ids(engine.search("zebra", aggregate=False)) == ["t:d7.md#other"] and not ids(engine.search("w8", fuzzy=0))
    engine.index(full=True)
    engine.vacuum()
    assert len(list((tmp_path / "index").glob("g-*"))) == 1 and engine.count() == whole.count()


def test_a_failed_update_leaves_the_index_in_force(spark, tmp_path, monkeypatch):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("# A\n\nalpha")
    engine = Engine(spark, str(tmp_path / "index"), Config(trees=[Tree("t", str(tmp_path / "docs"))]))
    engine.index()
    (tmp_path / "docs/b.md").write_text("# B\n\nbeta")
    with monkeypatch.context() as m:
        m.setattr(engine, "_put_current", lambda state: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            engine.index()
    assert engine.count() == 2 and engine.status() == "stale"
    assert engine.index()["added"] == 1 and engine.count() == 4


def test_stream(spark, tmp_path):
    schema = "doc_id string, mtime timestamp, body string"
    data, t = str(tmp_path / "in"), [D(2025, 1, i) for i in (1, 2)]
    ledger, seen = Ledger(spark, str(tmp_path / "ledger")), []

    def process(df, run):
        seen.append((run, sorted((r["doc_id"], r["mtime"].day) for r in df.collect())))

    for rows in ([("a", t[0], "x"), ("b", t[0], "y")], [("a", t[0], "x"), ("b", t[1], "z")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(data)
        ingest(chunk_stream(spark, data, schema), ledger, process, str(tmp_path / "cp")).awaitTermination()
    assert [rows for _, rows in seen] == [[("a", 1), ("b", 1)], [("b", 2)]]
    assert ledger.pairs().count() == 3


def test_command_line(tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    assert main(["init"]) == 0 and main(["init"]) == 1
    (tmp_path / "a.md").write_text("# A\n\nb")
    assert main(["inspect", "a.md"]) == 0 and "A" in capsys.readouterr().out
    assert main(["config"]) == 0 and main(["ls", "trees"]) == 0
    assert show([], "full") == "No results found."
    assert parser().parse_args(["search", "a", "b", "-t", "x"]).trees == ["x"]
    (tmp_path / "src").mkdir()
    (tmp_path / "src/tea_kettle-lid.md").write_text("# Kettle\n\nThe kettle boils water. Water boils.")
    assert main(["inspect", "ctx", "src/tea_kettle-lid.md"]) == 0
    assert capsys.readouterr().out.splitlines()[-3] == "path terms: tea, kettle, lid"


def test_shown_results(engine):
    rows = engine.search("ownership", cutoff_ratio=0.0).collect()
    assert show(rows, "matches").splitlines()[-2:] == ["Ownership keeps memory safe without a collector.", "Ownership also helps threads share memory."]
    painted = show(rows, "full", color=True)
    assert painted.count("\x1b[1;33mOwnership\x1b[0m") == 2
    assert "[aggregated: 2 matches]" in show(rows, "list", verbose=1) and show(rows, "list", verbose=1).splitlines()[-1].startswith("1 results, ")
    assert show(rows, "list").count("\n") == 0


def test_long_chunks_and_stopwords_of_a_file(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("---\nmetakey: 1\n---\n# Kettle\n\n" + "zebra kettle " * 20)
    (tmp_path / "stop.txt").write_text("Zebra\n")
    config = Config(trees=[Tree("t", str(tmp_path / "docs"))])
    config.settings |= {"max_chunk_size": 100, "stopwords_file": str(tmp_path / "stop.txt")}
    engine = Engine(spark, str(tmp_path / "index"), config)
    assert engine.index()["oversized"] == 1
    e, _ = engine.context_query([("x.md", "---\nmetakey: 1\n---\n# Kettle\n\nzebra kettle")], "tfidf")
    assert leaf_terms(e) == ["kettle"]

import os

import pytest
from pyspark.sql import functions as F

from arborseek.chunking import chunk_documents, chunk_file, chunk_markdown, frontmatter, slugify, tree_of
from arborseek.config import Rule, effective_trees, glob_regex, load_config, match_rules, matches, validate
from arborseek.functions.text import parse_id, slug
from arborseek.sources.files import discover, read_spans

SLUGS = {"Map<K, V> at a glance?": "mapk-v-at-a-glance", "Kettles": "kettles", "?!,;": "heading", "Tea -- and   - Milk": "tea-and-milk", "snake_case stays": "snake_case-stays", "Crème Brûlée": "crme-brle", "": "heading", " - ": "heading", "F# & G": "f-g", "日本": "heading", "2 Kettles": "2-kettles"}


def test_slugs(spark):
    assert {t: slugify(t) for t in SLUGS} == SLUGS
    df = spark.createDataFrame([(t,) for t in SLUGS], "t string")
    assert {r[0]: r[1] for r in df.select("t", slug("t")).collect()} == SLUGS


@pytest.mark.parametrize(
    ("text", "count"),
    [("Before all.\n\n## Kettle\n\nIt boils.\n\n# Teapot\n\nIt waits.\n\n## Lid", 3), ("## Kettle\n### Lid\n# Teapot", 2), ("# Kettle\n# Lid\n# Teapot", 1), (" \n", 1), ("# Tea\n\na\n\n# Tea\n\nb\n\n# Tea\n\nc\n\n## Milk\n\nd", 5)],
)
def test_node_counts(text, count):
    assert len(chunk_markdown(text, "a.md", "t")) == count


def test_spans_and_parents():
    text = "# Kettle\n\nIt böils.\n\n## Lid\n\nIt rattles.\n\n# Teapot\n\nIt waits."
    root = tree_of(text, "t")
    assert [text[c.start : c.end] for c in root.children] == ["It böils.\n\n## Lid\n\nIt rattles.\n\n", "It waits."]
    rows = chunk_markdown(text, "tea/pot.md", "home")
    assert [(r["id"], r["parent_id"], r["depth"], r["hierarchy"], r["sibling_count"]) for r in rows] == [
        ("home:tea/pot.md", None, 0, ["Kettle"], 1),
        ("home:tea/pot.md#kettle", "home:tea/pot.md", 1, ["Kettle"], 2),
        ("home:tea/pot.md#lid", "home:tea/pot.md#kettle", 2, ["Kettle", "Lid"], 1),
        ("home:tea/pot.md#teapot", "home:tea/pot.md", 1, ["Kettle", "Teapot"], 2),
    ]
    assert [r["body"] for r in rows] == ["", "It böils.\n\n", "It rattles.\n\n", "It waits."]
    raw = text.encode()
    assert [raw[r["byte_start"] : r["byte_end"]].decode() for r in rows[1:]] == ["It böils.\n\n## Lid\n\nIt rattles.\n\n", "It rattles.\n\n", "It waits."]
    slugs = [r["id"].partition("#")[2] for r in chunk_markdown("\n\n".join(f"## {t}\n\nx" for t in ["Tea", "Milk", "Milk", "Tea", "Milk"]), "a.md", "t")]
    assert slugs == ["", "tea", "milk", "milk-1", "tea-1", "milk-2"]


def test_headings_of_quotes_are_sections():
    rows = chunk_markdown("> # Said\n> words\n\n- ## Listed\n  more\n", "a.md", "t")
    assert [(r["id"], r["hierarchy"]) for r in rows[1:]] == [("t:a.md#said", ["Said"]), ("t:a.md#listed", ["Said", "Listed"])]


def test_large_files_come_out_alone(spark):
    text = "# A\n\n" + "x" * 9_000_000
    files = spark.createDataFrame([("t", f"{i}.md", text.encode()) for i in range(4)] + [("t", "none.md", None), ("t", "empty.md", b"")], "tree string, path string, content binary")
    assert chunk_documents(files).groupBy("depth").count().orderBy("depth").collect() == [(0, 6), (1, 4)]


@pytest.mark.parametrize(
    ("text", "title", "tags"),
    [
        ("---\ntitle: A\ntags: [x, y]\n---\nrest", "A", ["x", "y"]), ("---\ntitle: 'A: b'\n---\nrest", "A: b", []), ("---\ntags:\n  - x\n  - \"y z\"\nother: 1\n---\nrest", None, ["x", "y z"]), ("﻿---\r\ntitle: A\r\n---\r\nrest", "A", []), ("---\n---\nrest", None, []),
    ],
)
def test_frontmatter(text, title, tags):
    meta, rest = frontmatter(text)
    assert (meta.title, meta.tags, rest) == (title, tags, "rest")


@pytest.mark.parametrize("text", ["---\ntitle: A\nrest", "x\n---\ntitle: A\n---\n", "---\nnot yaml\n---\nrest", ""])
def test_no_frontmatter(text):
    assert frontmatter(text) == (None, text)


def test_ids():
    assert parse_id("t:a/b.md#c-d") == ("t", "a/b.md", "c-d") and parse_id("t:a.md") == ("t", "a.md", None)
    assert [parse_id(x) for x in ("C:\\a.md", "c:/a.md", "a.md", ":a", "t:", "")] == [None] * 6


def test_errors_are_rows():
    assert chunk_file(b"\xff", "a.md", "t")[0]["error"].startswith("invalid UTF-8")
    assert chunk_file(b"x", "a.rs", "t")[0]["error"].startswith("unsupported")
    (row,) = chunk_file(b"x", "sub/a.txt", "t")
    assert (row["hierarchy"], row["id"]) == (["a"], "t:sub/a.txt")


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [("*.rs", "src/api/handler.rs", True), ("**/*.md", "a.md", True), ("**/*.md", "x/y/a.md", True), ("drafts/**", "drafts/x/y.md", True), ("drafts/**", "my/drafts/x", False), ("*.{js,ts}", "a/b.ts", True), ("a?.md", "ab.md", True), ("[a-c]x", "bx", True), ("[!a]x", "ax", False), ("a.md", "a_md", False)],
)
def test_globs(pattern, path, hit):
    assert matches(path, [pattern]) == hit
    assert glob_regex(pattern)


def test_rules():
    rules = [Rule(["*.rs"], ["rust"], ["a", "b"], ["a:x.md"], {"limit": 3}), Rule(["src/*"], ["rust", "code"], ["b", "c"], [], {"limit": 9}), Rule(["*.py"], ["no"])]
    m = match_rules(rules, "src/a.rs")
    assert (m.terms, m.trees, m.include, m.overrides) == (["rust", "code"], ["b"], ["a:x.md"], {"limit": 3})
    assert match_rules(rules, "x").trees is None
    assert effective_trees(None, None) is None and effective_trees(["a"], ["b"]) == () and effective_trees(["a", "b"], ["b"]) == ("b",)


def test_config_and_discovery(spark, tmp_path):
    home, work = tmp_path / "home", tmp_path / "work" / "sub"
    for d in (home / "notes", work / "docs" / ".git"):
        d.mkdir(parents=True)
    (home / ".arborseek.toml").write_text('[settings]\nlimit = 5\ncutoff_ratio = 0.9\n[trees.notes]\npath = "notes"\n')
    (tmp_path / "work" / ".arborseek.toml").write_text('root = true\n[settings]\nlimit = 7\n[trees]\ndocs = "nowhere"\n[[rules]]\nmatch = "*.rs"\nterms = ["outer"]\n')
    (work / ".arborseek.toml").write_text('[trees.docs]\npath = "docs"\ninclude = ["**/*.md", "*.txt", "*.none"]\nexclude = ["drafts/**"]\n[[rules]]\nmatch = ["*.rs"]\nterms = ["inner"]\n')
    for name, data in {"a.md": "# A\n\nbödy", "sub.d/b.txt": "text", "drafts/c.md": "no", ".hidden.md": "no", ".git/x.md": "no", "i.png": "no", "bad.md": b"\xff"}.items():
        p = work / "docs" / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(data if isinstance(data, bytes) else data.encode())
    c = load_config(work, home=home)
    assert c.settings["limit"] == 7 and c.settings["cutoff_ratio"] == 0.9
    assert [(t.name, t.is_global) for t in c.trees] == [("docs", False), ("notes", True)]
    assert [r.terms for r in c.rules] == [["inner"], ["outer"]]
    assert validate(c) == ["tree docs: pattern *.none matches nothing"]
    assert load_config(work).hash() != c.hash()
    (tmp_path / "again").mkdir()
    (tmp_path / "again" / ".arborseek.toml").write_text("root = true\n" + c.to_toml())
    again = load_config(tmp_path / "again")
    assert (again.settings, [(t.name, t.path, t.include, t.exclude) for t in again.trees], again.rules) == (c.settings, [(t.name, t.path, t.include, t.exclude) for t in c.trees], c.rules)
    files = discover(spark, c.trees[:1])
    assert sorted(r["path"] for r in files.select("path").collect()) == ["a.md", "bad.md", "sub.d/b.txt"]
    rows = chunk_documents(files)
    assert {r["path"] for r in rows.where("error is not null").collect()} == {"bad.md"}
    good = read_spans(rows.where("error is null"), files).where(F.col("id").endswith("#a")).collect()
    assert [r["span"] for r in good] == ["bödy"]
    assert os.path.isdir(work)

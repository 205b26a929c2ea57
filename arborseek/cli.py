"""Command line: search, context, get, likethis, inspect, init, update, status, config, ls."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from arborseek.api import Engine
from arborseek.chunking import chunk_file
from arborseek.config import BINARY, load_config, match_rules, validate
from arborseek.functions.terms import telling_path_words
from arborseek.functions.text import parse_id
from arborseek.operators.highlight import lines_of_ranges, painted
from arborseek.operators.keywords import EXTRACTORS
from arborseek.query.ast import to_query
from arborseek.session import local_session

NAME = ".arborseek.toml"
SAMPLE = 50_000  # characters of a file that are looked at for the terms ``inspect ctx`` shows
TEMPLATE = '[settings]\nlimit = 10\n\n[trees.docs]\npath = "docs"\ninclude = ["**/*.md", "**/*.txt"]\n'


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="arborseek")
    p.add_argument("--index", default=".arborseek-index")
    sub = p.add_subparsers(dest="command", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("-n", "--limit", type=int)
    shared.add_argument("-t", "--tree", action="append", dest="trees")
    shared.add_argument("--no-aggregation", action="store_true")
    shared.add_argument("-o", "--output", choices=("full", "list", "matches", "json"), default="full")
    shared.add_argument("--fuzzy", type=int)
    shared.add_argument("--explain", action="store_true")
    shared.add_argument("-v", "--verbose", action="count", default=0)
    shared.add_argument("--cutoff-ratio", type=float, dest="cutoff_ratio")
    shared.add_argument("--aggregation-threshold", type=float, dest="threshold")
    shared.add_argument("--aggregation-pool-size", type=int, dest="pool")
    shared.add_argument("--local-boost", type=float, dest="local_boost")
    shared.add_argument("--color", choices=("auto", "always", "never"), default="auto")
    sub.add_parser("search", parents=[shared]).add_argument("query", nargs="+")
    c = sub.add_parser("context", parents=[shared])
    c.add_argument("files", nargs="+")
    c.add_argument("--algorithm", default="textrank")
    sub.add_parser("likethis", parents=[shared]).add_argument("source")
    g = sub.add_parser("get")
    g.add_argument("id")
    g.add_argument("--full-document", action="store_true")
    i = sub.add_parser("inspect", help="inspect doc FILE, inspect ctx FILE, or inspect FILE")
    i.add_argument("what", nargs="+", metavar="[doc|ctx] FILE")
    u = sub.add_parser("update")
    u.add_argument("--force", action="store_true")
    for name in ("init", "status", "config"):
        sub.add_parser(name)
    sub.add_parser("ls").add_argument("what", choices=("trees", "docs", "chunks"))
    return p


def show(rows, output: str, verbose: int = 0, color: bool = False, cutoff: str | None = None) -> str:
    """Results as text: header and breadcrumb; with ``full`` the text too, with ``matches`` only its lines that match."""
    if not rows:
        return "No results found."
    paint = painted if color else (lambda text, ranges: text)
    out, words, chars = [], 0, 0
    for r in rows:
        d = r.asDict(recursive=True)
        body, spans = d.get("body") or "", lambda k: [(x["offset"], x["length"]) for x in d.get(k) or ()]
        head = f"{d['id']}  {d['score']:.3f}"
        out.append(f"{head}  [aggregated: {len(d['constituents'])} matches]" if verbose and d.get("is_aggregated") else head)
        words, chars = words + len(body.split()), chars + len(body)
        if output != "list" and d.get("breadcrumb"):
            above, _, last = d["breadcrumb"].rpartition(d.get("title") or "\0")
            out.append(above + paint(d["title"], spans("title_ranges")) + last if d.get("title") and d["breadcrumb"].endswith(d["title"]) else d["breadcrumb"])
        if verbose and output != "matches":
            out.append(f"{len(body.split())} words, {len(body)} chars, score {d['score']:.2f}" + (f", {d['matches']} matches" if "matches" in d else ""))
        if output == "full":
            out += [paint(body, spans("ranges")), ""]
        elif output == "matches":
            for _, line, inner in lines_of_ranges(body, spans("ranges"), inner=True):
                out.append(paint(line, inner))
            out.append("")
    if verbose and output != "matches":
        out.append(", ".join([f"{len(rows)} results", f"{words} words", f"{chars} chars", *([cutoff] if cutoff else [])]))
    return "\n".join(out)


def inspect(kind: str, file: str, config) -> list[str]:
    """What a file's chunks are, or with ``ctx`` the terms its path, the rules and its text give."""
    if kind != "ctx":
        return [r["error"] or f"{r['position']:4d} {'  ' * r['depth']}{r['hierarchy'][-1]}  [{r['byte_start']}, {r['byte_end']})" for r in chunk_file(Path(file).read_bytes(), file, "file")]
    spark = local_session()
    parts = spark.createDataFrame([(file,)], "path string").select(telling_path_words("path").alias("words")).first()["words"]
    rules = match_rules(config.rules, file)
    sample = Path(file).read_text(encoding="utf-8", errors="replace")[:SAMPLE]
    return ["path terms: " + ", ".join(parts), "rule terms: " + ", ".join(rules.terms), "content terms: " + ", ".join(t for t, _ in EXTRACTORS["textrank"](sample)[:20])]


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "init":
        if Path(NAME).exists():
            print(f"{NAME} exists", file=sys.stderr)
            return 1
        Path(NAME).write_text(TEMPLATE)
        return 0
    config = load_config(Path.cwd(), NAME, Path.home())
    if a.command == "inspect":
        kind, file = (a.what[0], a.what[1]) if len(a.what) == 2 and a.what[0] in ("doc", "ctx") else ("doc", a.what[0])
        print("\n".join(inspect(kind, file, config)))
        return 0
    if a.command == "config":
        print(config.to_toml())
        return 0
    if a.command == "ls" and a.what == "trees":
        for t in config.trees:
            print(t.name, t.path, "global" if t.is_global else "local")
        return 0
    engine = Engine(local_session(), str(Path(a.index).resolve()), config)
    if a.command == "status":
        warnings = validate(config)
        print("\n".join([engine.status(), *warnings]))
        return int(bool(warnings))
    if a.command == "update":
        done = engine.index(full=a.force)
        print(", ".join(f"{k} {v}" for k, v in done.items()))
        if done["oversized"]:
            print(f"warning: {done['oversized']} chunks are longer than {config.settings['max_chunk_size']} characters", file=sys.stderr)
        return 0
    if engine.status() != "current":
        engine.index()
    try:
        if a.command == "get":
            print("\n".join(r["body"] or "" for r in engine.get(a.id, a.full_document).collect()))
            return 0
        if a.command == "ls":
            for r in (engine.list_docs() if a.what == "docs" else engine.list_chunks()).collect():
                print(*r)
            return 0
        given = {"limit": a.limit, "trees": a.trees, "fuzzy": a.fuzzy, "aggregate": False if a.no_aggregation else None, "cutoff_ratio": a.cutoff_ratio, "threshold": a.threshold, "pool": a.pool, "local_boost": a.local_boost}
        if a.command == "search":
            if a.explain:
                print(engine.explain(*a.query, **given))
                return 0
            results = engine.search(*a.query, **given)
        elif a.command == "context":
            files = []
            for f in a.files:  # missing and binary files are passed over, those that can't be read are told
                if Path(f).is_file() and Path(f).suffix[1:].lower() not in BINARY:
                    try:
                        files.append((str(Path(f).resolve()), Path(f).read_text(encoding="utf-8")))
                    except (OSError, UnicodeDecodeError) as e:
                        print(f"warning: {f}: {e}", file=sys.stderr)
            if a.explain:
                e, matched = engine.context_query(files, a.algorithm, a.trees)
                print(to_query(e) if e else "", matched.terms, matched.trees, matched.include)
                return 0
            results = engine.context(files, a.algorithm, **given)
        elif parse_id(a.source) and not Path(a.source).is_file():
            if a.explain:
                for r in engine.explain_like_this(a.source).collect():
                    print(f"{r['field']}:{r['term']}  df {r['df']}  weight {r['weight']:.3f}  score {r['score']:.3f}")
                return 0
            results = engine.like_this(id=a.source, **given)
        else:
            rows = chunk_file(Path(a.source).read_bytes(), a.source, "file")
            texts = {"body": "\n\n".join(r["body"] or "" for r in rows), "hierarchy": rows[0]["hierarchy"][-1] if rows[0]["hierarchy"] else "", "tags": " ".join(rows[0]["tags"] or [])}
            results = engine.like_this(fields=texts, exclude=tuple(engine.doc_ids_for([str(Path(a.source).resolve())])), **given)
        print(engine.to_json(" ".join(getattr(a, "query", [a.command])), results) if a.output == "json" else show(results.collect(), a.output, a.verbose, a.color == "always" or a.color == "auto" and sys.stdout.isatty()))
        return 0
    except (KeyError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

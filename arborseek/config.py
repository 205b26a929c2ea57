"""Configuration: layered TOML, globs, include rules, validation."""

from __future__ import annotations

import hashlib
import json
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from arborseek.operators.context import Matched

SCHEMA_VERSION = 2
# defaults of the settings; ``stopwords_file`` names a list of further stopwords, one a line
DEFAULTS = {"limit": 10, "aggregation_pool_size": 500, "cutoff_ratio": 0.3, "aggregation_threshold": 0.1, "local_boost": 1.5, "fuzzy_distance": 1, "stemmer": "english", "max_chunk_size": 50000, "context_terms": 50, "min_word_length": 4, "stopwords_file": ""}
# fixed values: extensions of files that hold no text
BINARY = (
    "7z a avi bin bmp bundle bz2 class dat db dll dmg doc docx dylib ear eot exe flac flv gif gz ico iso jar jpeg jpg lib lz lzma m4a mdb mkv mov mp3 mp4 o obj odt ogg otf pak pdf png ppt pptx psd "
    "pyc pyo rar rlib so sqlite svg svgz tar tgz tif tiff ttf war wasm wav webm webp wma wmv woff woff2 xls xlsx xz zip zst"
).split()


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression for whole paths: ``*`` and ``?`` cross ``/``, ``**/`` may be nothing, ``{a,b}`` and ``[a-z]``."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if c == "*":
            while pattern[i : i + 1] == "*":
                i += 1
            out.append(".*")
            continue
        if c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]")
            i = end + 1
            continue
        if c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"unclosed {{ in pattern: {pattern}")
    return "^" + "".join(out) + "$"


def matches(path: str, patterns: list[str]) -> bool:
    return any(re.match(glob_regex(p), path, re.S) for p in patterns)


@dataclass
class Tree:
    name: str
    path: str
    is_global: bool = False
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)


@dataclass
class Rule:
    match: list[str]
    terms: list[str] = field(default_factory=list)
    trees: list[str] | None = None
    include: list[str] = field(default_factory=list)
    overrides: dict = field(default_factory=dict)


@dataclass
class Config:
    settings: dict = field(default_factory=lambda: dict(DEFAULTS))
    trees: list[Tree] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)

    def hash(self) -> str:
        """Of everything that changes what an index holds, patterns too."""
        parts = [SCHEMA_VERSION, self.settings["stemmer"], self.settings["max_chunk_size"], [[t.name, t.path, t.include, t.exclude] for t in self.trees]]
        return hashlib.sha256(json.dumps(parts).encode()).hexdigest()

    def to_toml(self) -> str:
        """The configuration as it is in force, in a form that :func:`load_config` reads again."""
        line = lambda k, v: f"{k} = {json.dumps(v, ensure_ascii=False)}\n"
        out = ["[settings]\n", *(line(k, v) for k, v in self.settings.items())]
        for t in self.trees:
            out += [f"\n[trees.{json.dumps(t.name)}]\n", line("path", t.path), *(line(k, v) for k, v in (("include", t.include), ("exclude", t.exclude)) if v)]
        for r in self.rules:
            out += ["\n[[context.rules]]\n", line("match", r.match), line("terms", r.terms)]
            out += [line(k, v) for k, v in (("trees", r.trees), ("include", r.include)) if v is not None and (v or k == "trees")] + [line(k, v) for k, v in r.overrides.items()]
        return "".join(out)


def match_rules(rules: list[Rule], path: str) -> Matched:
    """All rules whose patterns match: terms and includes join, trees intersect, the first override of a setting counts."""
    made = Matched()
    for r in rules:
        if not matches(path, r.match):
            continue
        made.terms += [t for t in r.terms if t not in made.terms]
        made.include += [x for x in r.include if x not in made.include]
        if r.trees is not None:
            made.trees = list(r.trees) if made.trees is None else [t for t in made.trees if t in r.trees]
        made.overrides = {**r.overrides, **made.overrides}
    return made


def merge_matched(parts: list[Matched]) -> Matched:
    made = Matched()
    for p in parts:
        made.terms += [t for t in p.terms if t not in made.terms]
        made.include += [x for x in p.include if x not in made.include]
        if p.trees is not None:
            made.trees = list(p.trees) if made.trees is None else [t for t in made.trees if t in p.trees]
        made.overrides = {**p.overrides, **made.overrides}
    return made


def effective_trees(asked: list[str] | None, ruled: list[str] | None) -> tuple[str, ...] | None:
    """Trees to search: those asked for, of which rules may leave some; None for all, none at all if they are disjoint."""
    if asked is None:
        return None if ruled is None else tuple(ruled)
    return tuple(asked) if ruled is None else tuple(t for t in asked if t in ruled)


def _layer(path: Path, is_home: bool) -> dict:
    raw = tomllib.loads(path.read_text(encoding="utf-8"))
    trees = {}
    for name, t in raw.get("trees", {}).items():
        t = {"path": t} if isinstance(t, str) else t
        where = Path(t["path"]).expanduser()
        trees[name] = Tree(name, str((path.parent / where).resolve()), is_home, list(t.get("include", [])), list(t.get("exclude", [])))
    one = lambda v: [v] if isinstance(v, str) else list(v)
    rules = [Rule(one(r["match"]), list(r.get("terms", [])), r.get("trees"), list(r.get("include", [])), {k: r[k] for k in DEFAULTS if k in r}) for r in raw.get("context", {}).get("rules", raw.get("rules", []))]
    return {"root": raw.get("root", False), "settings": {k: v for k, v in {**raw.get("settings", {}), **raw.get("search", {})}.items() if k in DEFAULTS}, "trees": trees, "rules": rules}


def load_config(cwd: str | Path, name: str = ".arborseek.toml", home: str | Path | None = None) -> Config:
    """Layers from ``cwd`` up to the first with ``root = true``, the home file last: nearest settings and trees win, rules line up."""
    layers, seen = [], set()
    for folder in [Path(cwd).resolve(), *Path(cwd).resolve().parents]:
        file = folder / name
        if file.is_file():
            seen.add(file)
            layers.append(_layer(file, home is not None and file == Path(home, name).resolve()))
            if layers[-1]["root"]:
                break
    if home and (file := Path(home, name).resolve()).is_file() and file not in seen:
        layers.append(_layer(file, True))
    made = Config()
    trees: dict[str, Tree] = {}
    for layer in reversed(layers):
        made.settings.update(layer["settings"])
        trees.update(layer["trees"])
    made.trees = [trees[n] for n in sorted(trees)]
    made.rules = [r for layer in layers for r in layer["rules"]]
    return made


def validate(config: Config) -> list[str]:
    """Warnings: no trees, missing paths, paths that are no folders, patterns that match nothing."""
    out = [] if config.trees else ["no trees are configured"]
    for t in config.trees:
        path = Path(t.path)
        if not path.exists():
            out.append(f"tree {t.name}: {t.path} doesn't exist")
        elif not path.is_dir():
            out.append(f"tree {t.name}: {t.path} is no folder")
        else:
            names = [p.relative_to(path).as_posix() for p in path.rglob("*") if p.is_file()]
            out += [f"tree {t.name}: pattern {p} matches nothing" for p in t.include if not any(matches(n, [p]) for n in names)]
    return out

"""Documents to trees of chunks, one row for the document and one for each heading."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborseek.functions.markdown import headings

SCHEMA = (
    "id string, doc_id string, parent_id string, hierarchy array<string>, depth int, tags array<string>, path string, tree string, body string, "
    "position int, byte_start bigint, byte_end bigint, sibling_count int, error string"
)


def slugify(title: str) -> str:
    """ASCII letters, digits and ``_`` in lower case, blanks and dashes as single dashes; ``heading`` if nothing is left."""
    kept = re.sub(r"[^a-z0-9_ \-]", "", re.sub(r"[A-Z]", lambda m: m[0].lower(), title))
    return re.sub(r"[ \-]+", "-", kept).strip("-") or "heading"


@dataclass
class Frontmatter:
    title: str | None = None
    tags: list[str] = field(default_factory=list)


def _scalar(text: str) -> str | None:
    text = text.strip()
    if text[:1] in "\"'":
        end = text.find(text[0], 1)
        return text[1:end] if end > 0 else None
    return re.sub(r"\s+#.*$", "", text) or None


def frontmatter(content: str) -> tuple[Frontmatter | None, str]:
    """``title`` and ``tags`` of the leading ``---`` block and the text behind it; (None, all) if there is none or it is broken."""
    text = content.removeprefix("﻿")
    m = re.match(r"---[ \t]*\r?\n(.*?)(?:^|(?<=\n))---[ \t]*(?:\r?\n|\Z)", text, re.S | re.M)
    if not m:
        return None, content
    made, key = Frontmatter(), None
    for line in m[1].splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        item = re.match(r"\s*-\s+(.*)$", line)
        pair = re.match(r"([\w-]+)\s*:(?:\s+(.*))?$", line)
        if item and key is not None:
            if key == "tags" and (v := _scalar(item[1])):
                made.tags.append(v)
        elif pair:
            key, value = pair[1], (pair[2] or "").strip()
            if key == "title" and value:
                made.title = _scalar(value)
            elif key == "tags" and value:
                inner = value[1:-1].split(",") if value.startswith("[") and value.endswith("]") else [value]
                made.tags += [v for x in inner if (v := _scalar(x))]
        elif not line.startswith((" ", "\t")):
            return None, content  # no YAML mapping
    return made, text[m.end() :]


@dataclass
class Node:
    title: str
    level: int
    start: int  # of its span, in characters
    end: int
    line: int  # where its heading line starts
    slug: str | None = None
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)


def tree_of(text: str, title: str) -> Node:
    """The document node with its headings; those with an empty span are dropped, before slugs are given."""
    root = Node(title, 0, 0, len(text), 0)
    found = headings(text, nested=True)
    taken: Counter[str] = Counter()
    open_: list[Node] = [root]
    for i, h in enumerate(found):
        start = h.end + (1 if text[h.end : h.end + 1] == "\n" else 2 if text[h.end : h.end + 2] == "\r\n" else 0)
        end = next((x.start for x in found[i + 1 :] if x.level <= h.level), len(text))
        if start >= end:
            continue
        base = slugify(h.text)
        slug = base if not taken[base] else f"{base}-{taken[base]}"
        taken[base] += 1
        while open_[-1].level >= h.level:
            open_.pop()
        node = Node(h.text, h.level, start, end, h.start, slug, open_[-1])
        open_[-1].children.append(node)
        open_.append(node)
    return root


def _walk(node: Node) -> Iterator[Node]:
    yield node
    for c in node.children:
        yield from _walk(c)


def chunk_markdown(content: str, path: str, tree: str, strip_frontmatter: bool = False) -> list[dict]:
    """Rows of a Markdown file. With ``strip_frontmatter`` the leading block is no text of the document."""
    meta, rest = frontmatter(content)
    text = rest if meta and strip_frontmatter else content
    shift = len(content.encode()) - len(text.encode())
    marks = headings(text, nested=True)
    first = next((h.text for h in marks if h.level == 1), None)
    title = (meta.title if meta else None) or first or PurePosixPath(path).stem or "Untitled"
    root = tree_of(text, title)
    doc_id = f"{tree}:{path}"
    name = lambda n: doc_id if n.slug is None else f"{doc_id}#{n.slug}"
    nodes = list(_walk(root))
    places = sorted({0, *(n.start for n in nodes), *(n.end for n in nodes)})
    bytes_to = {0: 0}
    for a, b in zip(places, places[1:], strict=False):
        bytes_to[b] = bytes_to[a] + len(text[a:b].encode())
    first_heading = next((h.start for h in marks), len(text))
    rows = []
    for position, n in enumerate(nodes):
        end = n.children[0].line if n.children else first_heading if n.slug is None else n.end
        above, at = [], n
        while at.parent is not None:
            above.append(at)
            at = at.parent
        lineage = [title] + [x.title for x in reversed(above) if not (x.level == 1 and x.title == title)]
        whole = n.slug is None
        rows.append(
            {
                "id": name(n), "doc_id": doc_id, "parent_id": name(n.parent) if n.parent else None, "hierarchy": lineage, "depth": n.level, "tags": list(meta.tags) if meta else [], "path": path, "tree": tree,
                "body": text[n.start : end], "position": position, "byte_start": 0 if whole else shift + bytes_to[n.start], "byte_end": len(content.encode()) if whole else shift + bytes_to[n.end],
                "sibling_count": len(n.parent.children) if n.parent else 1, "error": None,
            }
        )
    return rows


def chunk_text(content: str, path: str, tree: str) -> list[dict]:
    """A plain text file is one document row."""
    doc_id = f"{tree}:{path}"
    title = PurePosixPath(path).stem or "Untitled"
    return [{"id": doc_id, "doc_id": doc_id, "parent_id": None, "hierarchy": [title], "depth": 0, "tags": [], "path": path, "tree": tree, "body": content, "position": 0, "byte_start": 0, "byte_end": len(content.encode()), "sibling_count": 1, "error": None}]


def chunk_file(content: bytes, path: str, tree: str, strip_frontmatter: bool = False) -> list[dict]:
    """Rows of a file by its extension; what can't be read gives one row that only says why."""
    suffix = PurePosixPath(path).suffix.lower()
    try:
        if suffix in (".md", ".markdown"):
            return chunk_markdown(content.decode("utf-8"), path, tree, strip_frontmatter)
        if suffix == ".txt":
            return chunk_text(content.decode("utf-8"), path, tree)
        problem = f"unsupported file type: {suffix or path}"
    except UnicodeDecodeError as e:
        problem = f"invalid UTF-8 at byte {e.start}"
    return [{k.split()[0]: None for k in SCHEMA.split(", ")} | {"doc_id": f"{tree}:{path}", "path": path, "tree": tree, "error": problem}]


def chunk_documents(files: DataFrame, strip_frontmatter: bool = False) -> DataFrame:
    """Chunk rows of ``files(tree, path, content)``, with ``error`` where a file couldn't be read. Files are read in parallel, each alone."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def frame(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=columns)
        for c in ("depth", "position", "byte_start", "byte_end", "sibling_count"):
            out[c] = out[c].astype("Int64")
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, held = [], 0
            for tree, path, content in zip(b["tree"], b["path"], b["content"], strict=True):
                made = chunk_file(bytes(content or b""), path, tree, strip_frontmatter)
                rows += made
                held += len(content or b"")
                if held > 16_000_000:  # large files come out alone
                    yield frame(rows)
                    rows, held = [], 0
            yield frame(rows)

    return files.select("tree", "path", F.col("content").cast("binary").alias("content")).mapInPandas(run, SCHEMA)

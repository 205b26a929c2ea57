"""Headings of Markdown text, found by a scan over its lines as CommonMark reads blocks."""

from __future__ import annotations

import re
from typing import NamedTuple


class Heading(NamedTuple):
    level: int
    text: str
    start: int  # of the heading's first line, in characters
    end: int  # behind its last line and that line's end


_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r" {0,3}(?:[-+*]|\d{1,9}[.)])(?:[ \t]|$)")
_INDENTED = re.compile(r"(?: {4}| {0,3}\t)")
# block starts of raw HTML: with a closing mark of their own, or up to the next blank line
_RAW = (
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
)
# fixed values: element names that open an HTML block in CommonMark
_BLOCK_NAMES = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link "
    "main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead "
    "title tr track ul"
).split()
_RAW_NAMED = re.compile(r" {0,3}</?(?:" + "|".join(_BLOCK_NAMES) + r")(?:[\s>]|/>|$)", re.I)

_CODE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)")
_INLINE = (
    (re.compile(r"!?\[((?:[^\[\]]|\[[^\[\]]*\])*)\](?:\([^()]*(?:\([^()]*\)[^()]*)*\)|\[[^\[\]]*\])"), lambda m: m[1]),
    (re.compile(r"<((?:https?|mailto):[^<>\s]*)>"), lambda m: m[1]),
    (re.compile(r"</?[A-Za-z][^<>]*>"), lambda m: ""),
    (re.compile(r"(\*{1,3})(?=\S)(.+?)(?<=\S)\1"), lambda m: m[2]),
    (re.compile(r"(?<!\w)(_{1,3})(?=\S)(.+?)(?<=\S)\1(?!\w)"), lambda m: m[2]),
)
_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")


def plain_inline(text: str) -> str:
    """The text a heading shows: emphasis, links and inline tags give way to what they hold; code spans stay verbatim."""
    code: list[str] = []

    def keep_code(m: re.Match) -> str:
        code.append(m[2].strip() or m[2])
        return f"\0{len(code) - 1}\0"

    text = _CODE.sub(keep_code, text.replace("\0", "\ufffd"))
    for pattern, keep in _INLINE:
        text = pattern.sub(keep, text)
    text = _ESCAPE.sub(r"\1", text).strip()
    return re.sub("\0(\\d+)\0", lambda m: code[int(m[1])], text)


_MARKER = re.compile(r" {0,3}(?:[-+*]|\d{1,9}[.)])(?=[ \t]|$)")
_QUOTE = re.compile(r" {0,3}>[ \t]?")


def _inside(body: str, boxes: list[int]) -> tuple[int, int]:
    """Of a line within open quotes (0) and list items (their indent) how many go on, and where its text starts."""
    at = 0
    for n, indent in enumerate(boxes):
        if indent == 0:
            m = _QUOTE.match(body, at)
            if not m:
                return n, at
            at = m.end()
        elif body[at:].strip():
            if body[at : at + indent].strip(" \t") or len(body[at:].expandtabs(4)) - len(body[at:].expandtabs(4).lstrip()) < indent:
                return n, at
            at += min(indent, len(body[at:]) - len(body[at:].lstrip()))
    return len(boxes), at


def _enter(body: str, at: int, boxes: list[int]) -> int:
    """Open the quotes and list items that begin at a line's text; where the text within them starts."""
    while True:
        if m := _QUOTE.match(body, at):
            boxes.append(0)
            at = m.end()
        elif (m := _MARKER.match(body, at)) and not _RULE.match(body[at:]):
            blanks = len(body) - m.end() - len(body[m.end() :].lstrip(" "))
            blanks = 1 if blanks > 4 or not body[m.end() :].strip() else blanks
            boxes.append(m.end() - at + max(1, blanks))
            at = min(len(body), m.end() + blanks)
        else:
            return at


def headings(text: str, nested: bool = False) -> list[Heading]:
    """ATX and setext headings in order. Fenced and indented code and raw HTML blocks hold none.

    With ``nested`` those in quotes and list items count too; they start at their text, behind the marks of the quote or item.
    """
    found: list[Heading] = []
    fence: str | None = None
    raw: re.Pattern | None = None
    until_blank = False
    paragraph: list[tuple[int, str]] = []  # lines of the open paragraph
    boxes: list[int] = []
    at = 0
    for line in text.splitlines(keepends=True) if "\r" not in text else re.split(r"(?<=\n)", text):
        start, at = at, at + len(line)
        body = line.rstrip("\r\n")
        if nested and (boxes or ">" in body or _MARKER.match(body)):
            kept, inner = _inside(body, boxes)
            if kept < len(boxes):
                del boxes[kept:]
                fence, raw, until_blank = None, None, False
                # a paragraph may go on without its marks, but no heading comes of it then
                paragraph = []
            if not (fence or raw or until_blank) and not (_INDENTED.match(body, inner) and not paragraph):
                depth = len(boxes)
                inner = _enter(body, inner, boxes)
                if len(boxes) > depth:
                    paragraph = []
            start, body = start + inner, body[inner:]
        if fence:
            close = _FENCE.match(body)
            if close and close[1][0] == fence[0] and len(close[1]) >= len(fence) and not body.strip().strip(fence[0]):
                fence = None
            continue
        if raw:
            if raw.search(body):
                raw = None
            continue
        if until_blank:
            until_blank = bool(body.strip())
            continue
        if not body.strip():
            paragraph = []
            continue
        if not paragraph and _INDENTED.match(body):
            continue
        if m := _FENCE.match(body):
            fence, paragraph = m[1], []
            continue
        if (m := _ATX.match(body)) and not _INDENTED.match(body):
            found.append(Heading(len(m[1]), plain_inline("" if (m[2] or "").strip("#") == "" else m[2]), start, at))
            paragraph = []
            continue
        if paragraph and (m := _SETEXT.match(body)):
            shown = plain_inline("".join(x.strip() for _, x in paragraph))
            found.append(Heading(1 if m[1][0] == "=" else 2, shown, paragraph[0][0], at))
            paragraph = []
            continue
        if _RULE.match(body):
            paragraph = []
            continue
        opened = next((end for begin, end in _RAW if begin.match(body)), None)
        if opened:
            raw, paragraph = (None if opened.search(body, 4) else opened), []
            continue
        if _RAW_NAMED.match(body):
            until_blank, paragraph = True, []
            continue
        if not nested and (body.lstrip().startswith(">") or _ITEM.match(body)):
            paragraph = []
            continue
        paragraph.append((start, body))
    return found

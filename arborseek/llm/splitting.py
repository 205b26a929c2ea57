"""Cutting texts above a size limit into overlapping pieces at natural boundaries.

A hierarchy of separators is tried from the coarsest down: section, paragraph, sentence, word, character. Pieces are
packed greedily: each reaches to the last boundary of the coarsest kind that leaves it within the limit, and only
where none lies in reach the next finer kind is used. The next piece starts ``overlap`` characters before the end
of the last, so consecutive pieces share exactly so many and every character of the text is in a piece.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborseek.functions.markdown import headings
from arborseek.operators.current import current_rows

DEFAULT_SIZE, DEFAULT_AT_HEADINGS, DEFAULT_OVERLAP = 50000, True, 0
KINDS = ("section", "paragraph", "sentence", "word", "character")

_HTML_HEADING = re.compile(r"^[ \t]*<h[1-6][ \t>]", re.I | re.M)
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[”’」』）]*\s*|\n\s*")
_WORD = re.compile(r"\s+|[，、；：]")
# a cut before one of these would part it from the character it belongs to: combining marks, joiners, variation
# selectors, skin tones, the line feed of a pair
_JOINED = re.compile(r"[\u0300-\u036f\u0483-\u0489\u0591-\u05bd\u064b-\u065f\u0900-\u0903\u093a-\u094f\u0e31\u0e34-\u0e3a\u1ab0-\u1aff\u1dc0-\u1dff\u200d\u20d0-\u20ff\u3099\u309a\ufe00-\ufe0f\ufe20-\ufe2f\U0001f3fb-\U0001f3ff\U000e0020-\U000e007f]")


def parts_character(text: str, at: int) -> bool:
    """Whether a cut at ``at`` would part a character as a reader sees it; the ends of the text part none."""
    if not 0 < at < len(text):
        return False
    run = 0
    if "\U0001f1e6" <= text[at] <= "\U0001f1ff":
        while at - 1 - run >= 0 and "\U0001f1e6" <= text[at - 1 - run] <= "\U0001f1ff":
            run += 1
    pair = text[at - 1] == "\r" and text[at] == "\n"
    return bool(_JOINED.match(text, at) or text[at - 1] == "\u200d" or pair or run % 2)


def boundaries(text: str, at_headings: bool) -> list[tuple[str, list[int]]]:
    """Places to cut, in order, of each kind from the coarsest down; of characters none are listed."""
    found = []
    if at_headings:
        starts = {h.start for h in headings(text)} | {m.start() for m in _HTML_HEADING.finditer(text)}
        found.append(("section", sorted(starts)))
    for kind, pattern in (("paragraph", _PARAGRAPH), ("sentence", _SENTENCE), ("word", _WORD)):
        found.append((kind, [m.end() for m in pattern.finditer(text)]))
    return found


def pieces(text: str, size: int, at_headings: bool = True, overlap: int = 0) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of each piece, in characters; ``kind`` says at what the piece ends, ``end`` for the last.

    A text within ``size`` is one piece, an empty one has none. An overlap of ``size`` or more is cut to ``size - 1``,
    so that every piece gets on.

    No piece ends within a character, unless one is longer than the limit. None starts within one either where a place
    to cut allows it: of the places those are left out that would part a character, there or ``overlap`` before. Where
    no place within reach does both, the overlap stays exact, and the next piece starts within a character.
    """
    if size < 1:
        raise ValueError("the size limit must be at least 1")
    overlap = max(0, min(overlap, size - 1))
    out: list[tuple[int, int, str]] = []
    start, places = 0, None
    while start + size < len(text):
        if places is None:
            places = boundaries(text, at_headings)
        low, high = start + (overlap if out else 0), start + size
        # a piece must end behind the overlap with the next one, or the next would start where this one did
        low = max(low, start + overlap)
        for kind, at in [*places, ("character", range(high + 1))]:
            k = bisect_right(at, high) if kind != "character" else high + 1
            while k and at[k - 1] > low and (parts_character(text, at[k - 1]) or overlap and parts_character(text, at[k - 1] - overlap)):
                k -= 1
            if k and at[k - 1] > low:
                end = at[k - 1]
                break
        else:
            kind, end = "character", next((e for e in range(high, low, -1) if not parts_character(text, e)), high)
        out.append((start, end, kind))
        start = end - overlap
    if text:
        out.append((start, len(text), "end"))
    return out


def effective_settings(settings: DataFrame) -> DataFrame:
    """``(tree, max_chunk_size, chunk_at_headings, chunk_overlap)``: of each, the nearest layer's value that is set.

    Sizes below 1 and overlaps below 0 count as not set; of several values in one layer the smallest is taken.
    Rows without tree or layer are left out.
    """

    def nearest(name: str, valid) -> F.Column:
        return F.min(F.when(valid, F.struct("layer", name)))[name].alias(name)

    return (
        settings.where("tree is not null and layer is not null")
        .groupBy("tree")
        .agg(
            nearest("max_chunk_size", F.col("max_chunk_size") > 0),
            nearest("chunk_at_headings", F.col("chunk_at_headings").isNotNull()),
            nearest("chunk_overlap", F.col("chunk_overlap") >= 0),
        )
    )


def oversized(chunks: DataFrame, settings: DataFrame) -> DataFrame:
    """``(id, body, size, at_headings, overlap)`` of the current rows above their tree's limit.

    Only oversized bodies are shuffled on the way to the current row of each id. A null tree has the defaults.
    """
    known = effective_settings(settings).withColumnRenamed("tree", "__tree")
    joined = chunks.join(known, F.col("tree") == F.col("__tree"), "left")
    size = F.coalesce("max_chunk_size", F.lit(DEFAULT_SIZE))
    rows = current_rows(
        joined,
        F.when(F.char_length("body") > size, F.col("body")).alias("body"),
        size.alias("size"),
        F.coalesce("chunk_at_headings", F.lit(DEFAULT_AT_HEADINGS)).alias("at_headings"),
        F.coalesce("chunk_overlap", F.lit(DEFAULT_OVERLAP)).alias("overlap"),
    )
    return rows.where("body is not null")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.string()), ("piece", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("ends_at", pa.string()), ("text", pa.string())])
    for b in batches:
        for row in b.to_pylist():  # texts here are long; a batch of pieces for each keeps batches small
            made = pieces(row["body"], row["size"], row["at_headings"], row["overlap"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["id"]] * len(made), pa.string()),
                    pa.array(range(len(made)), pa.int32()),
                    pa.array([m[0] for m in made], pa.int64()),
                    pa.array([m[1] for m in made], pa.int64()),
                    pa.array([m[2] for m in made], pa.string()),
                    pa.array([row["body"][m[0] : m[1]] for m in made], pa.string()),
                ],
                schema=schema,
            )


def split(rows: DataFrame) -> DataFrame:
    """``(id, piece, start, end, ends_at, text)`` of rows as :func:`oversized` gives them."""
    return rows.select("id", "body", "size", "at_headings", "overlap").mapInArrow(_cut, "id string, piece int, start long, end long, ends_at string, text string")

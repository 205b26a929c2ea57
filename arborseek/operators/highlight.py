"""Match ranges in bytes, merged ranges, matching lines, snippets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborseek.functions.stem import stemmer
from arborseek.functions.text import LONGEST
from arborseek.functions.text import terms as found

SNIPPET = 150
RANGE = "struct<offset:bigint,length:bigint>"
_RUN = re.compile(r"[^\W_]+")


def edits(a: str, b: str, most: int) -> bool:
    """Whether two words are within ``most`` edits, a swap of two characters that stand or come to stand together being one."""
    if abs(len(a) - len(b)) > most:
        return False
    if most == 0 or a == b:
        return a == b
    far, last = len(a) + len(b), {}
    table = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, match = [far, i], 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            match = j if x == y else match
            row.append(min(table[i][j] + (x != y), row[j] + 1, table[i][j + 1] + 1, table[k][m] + (i - k - 1) + 1 + (j - m - 1)))
        table.append(row)
        last[x] = i
    return table[-1][-1] <= most


class NearWords:
    """The words within an edit distance of those asked for, as a set that is never listed: ``in`` and ``get`` test a word."""

    def __init__(self, words: list[str], distance: int = 0):
        self.words, self.distance, self.known = frozenset(words), distance, {}

    def __contains__(self, word: str) -> bool:
        if word in self.words or not self.distance:
            return word in self.words
        if word not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[word] = any(edits(word, w, self.distance) for w in self.words)
        return self.known[word]

    def get(self, word: str) -> float | None:
        return 1.0 if word in self else None


def byte_ranges(text: str, terms: set[str] | NearWords, language: str = "none", touching: bool = True) -> list[tuple[int, int]]:
    """``(offset, length)`` in UTF-8 bytes of the words whose term is asked for, touching ones merged."""
    word = stemmer(language)
    found: list[tuple[int, int]] = []
    at = last = 0
    for m in _RUN.finditer(text):
        shown = m[0].lower()
        if len(shown.encode()) < LONGEST and word(shown) in terms:
            at += len(text[last : m.start()].encode())
            size = len(m[0].encode())
            if touching and found and found[-1][0] + found[-1][1] >= at:
                found[-1] = (found[-1][0], at + size - found[-1][0])
            else:
                found.append((at, size))
            at, last = at + size, m.end()
    return found


def with_ranges(rows: DataFrame, column: str, terms: list[str] | NearWords, language: str = "none", out: str = "ranges") -> DataFrame:
    """Adds the byte ranges of matching words in a text column; null gives none. Meant for results, after the limit."""
    wanted = terms if isinstance(terms, NearWords) else set(terms)

    @F.pandas_udf(f"array<{RANGE}>")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"offset": o, "length": n} for o, n in byte_ranges(t, wanted, language)] if t else [])

    return rows.withColumn(out, find(column))


def with_matches(rows: DataFrame, columns: list[str], terms: list[str] | NearWords, language: str = "none", out: str = "matches") -> DataFrame:
    """Adds how many words of some text columns match; null texts have none. Meant for results, after the limit."""
    wanted = terms if isinstance(terms, NearWords) else set(terms)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(byte_ranges(t, wanted, language, touching=False)) if t else 0)

    return rows.withColumn(out, count(F.concat_ws(" ", *columns)))


def merged(ranges: Column) -> Column:
    """An array of ranges in order, those that overlap or touch joined."""
    end = lambda r: r["offset"] + r["length"]
    sort = F.array_sort(ranges)

    def step(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["offset"].alias("offset"), (F.greatest(end(last), end(r)) - last["offset"]).alias("length"))
        kept = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when((F.size(done) > 0) & (r["offset"] <= end(last)), F.concat(kept, F.array(joined))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(sort, F.array().cast(f"array<{RANGE}>"), step)


def lines_of_ranges(text: str, ranges: list[tuple[int, int]], inner: bool = False) -> list[tuple]:
    """``(number, line)`` of the lines that overlap one of the byte ranges, numbered from 1; with ``inner`` their parts of the ranges too."""
    out, at = [], 0
    for n, line in enumerate(text.split("\n"), 1):
        size = len(line.encode())
        own = [(max(o, at) - at, min(o + length, at + size) - max(o, at)) for o, length in ranges if o < at + size and o + length > at]
        if own:
            out.append((n, line, own) if inner else (n, line))
        at += size + 1
    return out


def painted(text: str, ranges: list[tuple[int, int]], before: str = "\x1b[1;33m", behind: str = "\x1b[0m") -> str:
    """The text with marks around its byte ranges, which may touch or overlap; those beyond its end are left out."""
    raw, out, at = text.encode(), [], 0
    for o, length in sorted(ranges):
        start, end = max(o, at), o + length
        if end <= len(raw) and start < end:
            out += [raw[at:start], before.encode(), raw[start:end], behind.encode()]
            at = end
    return b"".join([*out, raw[at:]]).decode(errors="replace")


def merge_ranges(rows: DataFrame, key: str = "id") -> DataFrame:
    """Of ``(key, start, end)`` the union of overlapping or touching ranges of each key; empty and null ranges drop out."""
    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.where(F.col("start") < F.col("end")).withColumn("__new", F.when(F.col("start") <= reach, 0).otherwise(1))
    islands = opened.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def shift_ranges(ranges: Column, by: Column, size: Column) -> Column:
    """Ranges of a child moved to its parent's text, those that leave it dropped."""
    moved = F.transform(ranges, lambda r: F.struct((r["offset"] + by).alias("offset"), r["length"].alias("length")))
    return F.filter(moved, lambda r: (r["offset"] >= 0) & (r["offset"] + r["length"] <= size))


def lines(rows: DataFrame, column: str = "body", key: str = "id") -> DataFrame:
    """``(key, line, start, end, text)`` of each line, numbered from 1, with its byte range without the line end."""
    split = F.split(F.col(column), "\n")
    each = rows.where(F.col(column).isNotNull()).select(key, F.posexplode(split).alias("place", "text"))
    size = F.octet_length("text") + 1
    before = F.sum(size).over(Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0).cast("long"))
    return each.select(key, (F.col("place") + 1).alias("line"), start.alias("start"), (start + F.octet_length("text")).alias("end"), "text")


def matching_lines(rows: DataFrame, terms: list[str], column: str = "body", key: str = "id") -> DataFrame:
    """``(key, line, text)`` of the lines that hold a word of ``terms``; a word lies within its line, so lines are tested alone."""
    held = F.arrays_overlap(found("text"), F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>"))
    each = rows.where(F.col(column).isNotNull()).select(key, F.posexplode(F.split(F.col(column), "\n")).alias("place", "text"))
    return each.where(held).select(key, (F.col("place") + 1).alias("line"), "text")


def snippet_of(text: str, weights: dict[str, float] | NearWords, language: str = "none", size: int = SNIPPET) -> str:
    """The fragment of at most ``size`` characters with the greatest sum of weights, its words in ``<b>``; the first of equals."""
    word = stemmer(language)
    spots = [(m.start(), m.end(), w) for m in _RUN.finditer(text) if (w := weights.get(word(m[0].lower())))]
    if not spots:
        return ""
    best, start, total, left = (0.0, 0), 0, 0.0, 0
    for right, (begin, end, w) in enumerate(spots):
        total += w
        while left < right and end - spots[left][0] > size:
            total -= spots[left][2]
            left += 1
        if total > best[0] + 1e-12:
            best, start = (total, left), spots[left][0]
    cut = text[start : start + size]
    if start + size < len(text) and (m := re.search(r"\s\S*\Z", cut)) and any(e <= start + m.start() for _, e, _ in spots if e > start):
        cut = cut[: m.start()]
    out, at = [], 0
    for begin, end, _ in spots:
        if begin >= start and end <= start + len(cut):
            out += [cut[at : begin - start], "<b>", cut[begin - start : end - start], "</b>"]
            at = end - start
    return "".join(out) + cut[at:]


def with_snippet(rows: DataFrame, column: str, weights: dict[str, float] | NearWords, language: str = "none") -> DataFrame:
    """Adds ``snippet``; null and unmatched texts have an empty one. Meant for results, after the limit."""

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet_of(t, weights, language) if t else "")

    return rows.withColumn("snippet", find(column))

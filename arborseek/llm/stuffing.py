"""Pages of stuffed keywords, link lists, tag and attribute lists instead of sentences.

Each line of a page is read as one of: code, table or log (left alone), list evidence (links only, hashtags, short
items in a row, or words of a phrase the page keeps repeating), sentence, or in doubt: no sentence and no list. All
lines of all documents are taken apart into five-word shingles, and for those that stand in doubtful lines of a page
with list evidence the distinct hosts are counted over the whole corpus; where most of a page's doubtful shingles stand
on other hosts too, the page is stitched from replicated phrases and its doubtful words join the list evidence. A page
is spam if that evidence makes up three quarters of its words. Replication alone says little here, since pages in set
phrases share whole sentences with many hosts; so it speaks only where a line has no sentence.

Which shingles are asked for is sent to the documents as a set of bits of a fixed size: a shingle whose bit isn't set
is asked for by no page and stays where it is, and what passes is joined exactly. Where pages ask for more than the
bits tell apart, more is shuffled, and the result is the same.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborseek.session import written

SHARE = 0.75
SHINGLE = 5
REPLICATED = 0.5  # share of a page's doubtful shingles that other hosts hold too
LISTED = 0.25  # share of a page's words that must be list evidence for replicated phrases to join it
FEWEST = 15  # words; a page with fewer is a stub, unless it has
LINKS = 5  # lines of links and nothing else
FILTER_BITS = 26  # the shingles asked for, as so many bits of their hashes: at most 8 MB, whatever the corpus
REPEATED = (5, 0.08)  # a pair of neighbours is stuffed if it stands so often, and makes up this share of the words,
COVERED = 0.5  # or if all pairs that stand so often outside of sentences, headings, tables and logs cover this share
VARIED = 0.4  # share of different words from which a punctuated line is a sentence, whatever pairs it repeats,
SENTENCE = (7, 0.75)  # or if half of it are sentences of so many different words, and such a share of different ones

_LINE = re.compile(r"\r\n|\r|\n")
_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_URL = re.compile(r"\b(?:https?|ftp)://[^\s<>()\[\]\"']+|\bwww\.[^\s<>()\[\]\"']+", re.I)
_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*[^()]*\)|\[\[([^\[\]]*)\]\]|\[((?:https?|ftp)://[^\s\[\]]+[^\[\]]*)\]|<a\s[^<>]*>(.*?)</a>|<((?:https?|mailto):[^<>\s]*)>", re.I)
_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>")
_WORD = re.compile(r"[^\W_]+")
_STAMP = re.compile(r"\s*\[?(?:\d{4}-\d\d-\d\d[T ]|\d\d:\d\d:\d\d)")
_LEVEL = re.compile(r"\b(?:DEBUG|INFO|WARN|WARNING|ERROR|FATAL|TRACE)\b")
_HASHTAG = re.compile(r"(?<!\S)#[^\W_][\w-]*")
_ITEM = re.compile(r"\s*[,;|·•/、]\s*")
_BULLET = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s+")
_HEADING = re.compile(r"\s{0,3}#{1,6}\s")
_STOP = re.compile(r"[.!?…。！？]+(?=\s|$)|[。！？]")
_ENDS, _CLOSERS = frozenset(".!?…。！？:："), "\"'”’»)]*_"


def _links_only(line: str) -> tuple[int, int]:
    """Words inside and outside of a line's links; a bare address is one word."""
    inside = 0

    def take(m: re.Match) -> str:
        nonlocal inside
        inside += len(_WORD.findall(_URL.sub("", next((g for g in m.groups() if g), "")))) or 1
        return " "

    rest = _LINK.sub(take, line)
    rest, bare = _URL.subn(" ", rest)
    return inside + bare, len(_WORD.findall(_TAG.sub(" ", _BULLET.sub("", rest))))


def _words(line: str, linked: bool) -> list[str]:
    """A line's words in lower case, those of its links too, without addresses and tags."""
    if not linked:
        return _WORD.findall((_TAG.sub(" ", line) if "<" in line else line).lower())
    shown = _LINK.sub(lambda m: _URL.sub(" ", next((g for g in m.groups() if g), "")), line)
    return _WORD.findall(_TAG.sub(" ", _URL.sub(" ", shown)).lower())


def _ended(line: str) -> bool:
    """Whether a line ends like a sentence, closing quotes and marks aside."""
    return line.rstrip().rstrip(_CLOSERS)[-1:] in _ENDS if line else False


def _sentences(line: str, count: int) -> bool:
    """Whether at least half of a line's ``count`` words stand in sentences that hardly repeat a word, however often these are repeated."""
    told = 0
    for part in _STOP.split(line):
        words = _WORD.findall(part.lower())
        if len(different := set(words)) >= SENTENCE[0] and len(different) >= SENTENCE[1] * len(words):
            told += len(words)
    return told * 2 >= count


def _shaped(line: str) -> bool:
    """Whether a line is a heading, a row of a table or of a log."""
    start = line.lstrip()[:1]
    if start == "|":
        return True
    if start == "#" and _HEADING.match(line):
        return True
    return bool((start.isdigit() or start == "[") and _STAMP.match(line) or not line.islower() and _LEVEL.search(line))


def _linked(line: str) -> bool:
    return "://" in line or "[[" in line or "www." in line or "](" in line or "<a " in line


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_known = _Hashes()
_FACTORS = [np.uint64(0x9E3779B97F4A7C15 ** (k + 1) % 2**64) for k in range(SHINGLE)]


def shingles(lines: list[list[str]], once: bool = True) -> np.ndarray:
    """Signed 64-bit hashes of all five-word shingles of the lines, each once unless told otherwise; none spans two lines."""
    lines = [x for x in lines if len(x) >= SHINGLE]
    if not lines:
        return np.empty(0, np.int64)
    if len(_known) > 500_000:
        _known.clear()
    of_words = np.fromiter(map(_known.__getitem__, chain.from_iterable(lines)), np.uint64)
    n = len(of_words) - SHINGLE + 1
    sums = np.zeros(n, np.uint64)
    for k, factor in enumerate(_FACTORS):
        sums += of_words[k : k + n] * factor
    whole = np.ones(n, bool)
    ends = np.cumsum([len(x) for x in lines])[:-1]
    for k in range(1, SHINGLE):
        whole[ends - k] = False
    sums = sums[whole]
    mixed = sums ^ (sums >> np.uint64(32))
    return (np.unique(mixed) if once else mixed).view(np.int64)


def _hit(words: list[str], pairs: set[tuple[str, str]]) -> list[bool]:
    """Which words stand in one of the pairs."""
    hit = [False] * len(words)
    for i, p in enumerate(zip(words, words[1:], strict=False)):
        if p in pairs:
            hit[i] = hit[i + 1] = True
    return hit


def _lines(text: str) -> list[str]:
    """The lines of a text, character references read."""
    return _LINE.split(html.unescape(text) if "&" in text else text)


class Page:
    """Counts of a page's words: ``total``, ``sure`` list evidence, and ``doubt`` with its word sequences; ``links`` counts lines of links."""

    def __init__(self, text: str):
        lines, fence = [], None
        for line in _lines(text):
            mark = _FENCE.match(line) if "```" in line or "~~~" in line else None
            if fence:
                fence = None if mark and mark[1].startswith(fence) else fence
                kind = "code"
            elif mark:
                fence, kind = mark[1][:3], "code"
            else:
                kind = ""
            if line.strip():
                lines.append((kind, line))
        self.total = self.sure = self.doubt = self.links = 0
        self.phrases: list[list[str]] = []
        read = []
        pairs: Counter[tuple[str, str]] = Counter()
        loose: Counter[tuple[str, str]] = Counter()
        for kind, line in lines:
            linked = _linked(line)
            inside, outside = _links_only(line) if linked else (0, 0)
            words = _words(line, linked)
            varied = _ended(line) and (len(set(words)) >= VARIED * len(words) or _sentences(line, len(words)))
            shaped = _shaped(line)
            read.append((kind, line, words, inside, outside, linked, varied, shaped))
            self.total += max(len(words), inside + outside)
            if not kind:
                pairs.update(zip(words, words[1:], strict=False))
                if not varied and not shaped:
                    loose.update(zip(words, words[1:], strict=False))
        least = max(REPEATED[0], REPEATED[1] * self.total)
        stuffed = {p for p, n in pairs.items() if n >= least}
        often = {p for p, n in loose.items() if n >= REPEATED[0]}
        if often and sum(sum(_hit(words, often)) for kind, _, words, *_, varied, shaped in read if not (kind or varied or shaped)) < COVERED * self.total:
            often = set()
        for kind, line, words, inside, outside, linked, varied, shaped in read:
            count = max(len(words), inside + outside)
            if kind or not count:
                continue
            telling = stuffed if shaped else stuffed | often
            if telling and not varied:
                if sum(_hit(words, telling)) * 2 >= len(words) > 0:
                    self.sure += count
                    continue
            if linked and inside and outside <= 2:
                self.sure += count
                self.links += 1
                continue
            stripped = line.strip()
            if "#" in line and _HASHTAG.search(line) and len(_HASHTAG.findall(line)) * 5 >= len(stripped.split()) * 3:
                self.sure += count
                continue
            if shaped or "<" in stripped and _TAG.sub("", stripped) == "":
                continue
            if not _ended(_URL.sub("", stripped) if linked else stripped):
                items = [x for x in _ITEM.split(_TAG.sub(" ", _URL.sub(" ", stripped) if linked else stripped)) if x.strip()]
                if len(items) >= 3 and len(words) <= 2.6 * len(items) + 2 * (len(items) > 3):
                    self.sure += count
                elif len(words) >= SHINGLE:
                    self.doubt += count
                    self.phrases.append(words)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for doc, host, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            page = Page(text)
            if page.sure or page.doubt:
                stub = page.total < FEWEST and page.links < LINKS
                out.append((doc, host, page.total, page.sure, page.doubt, stub, shingles(page.phrases)))
        cols = list(zip(*out, strict=True)) or [()] * 7
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "host", "total", "sure", "doubt", "stub", "shingles"])


def _texts(documents: DataFrame) -> DataFrame:
    return documents.where("length(text) > 0").select("doc_id", F.xxhash64(F.coalesce("source", F.lit(""))).alias("host"), "text")


def evidence(documents: DataFrame) -> DataFrame:
    """``(doc_id, host, total, sure, doubt, stub, shingles)`` of every page with any evidence, as a written table.

    ``documents`` has ``doc_id, text, source``; the source is the host, a null one the host ''; ``host`` is its hash.
    Null and empty texts have none. Other columns are ignored.
    """
    return written(_texts(documents).mapInArrow(_read, "doc_id long, host long, total int, sure int, doubt int, stub boolean, shingles array<long>"), "page-evidence")


def asked_for(wanted: DataFrame) -> bytes:
    """The hashes of ``wanted(shingle)`` as bits, by their first FILTER_BITS; they are set where the shingles lie and then joined."""
    place = F.shiftrightunsigned("shingle", 64 - FILTER_BITS) + 1
    parts = wanted.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bits = bytearray(1 << (FILTER_BITS - 3))
    for r in parts.collect():  # at most as many as the bits have parts
        at = (r["bucket"] - 1) * len(r["bits"])
        bits[at : at + len(r["bits"])] = r["bits"]
    return bytes(bits)


def _explode(sent):
    """Rows ``(doc_id, host, text)`` to ``(shingle, host)`` of the shingles of all lines whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(zlib.decompress(sent.value), np.uint8)
        for b in batches:
            found, hosts = [], []
            for host, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                plain = not _linked(text)
                made = shingles([_words(line, not plain and _linked(line)) for line in _lines(text)], once=False)
                place = made.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
                kept = np.unique(made[(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0])
                if len(kept):
                    found.append(kept)
                    hosts.append(np.full(len(kept), host, np.int64))
            empty = np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*x, empty])) for x in (found, hosts)], names=["shingle", "host"])

    return run


def phrase_hosts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(shingle, hosts)``: on how many distinct hosts each shingle of ``wanted(shingle)`` stands, over all lines of all non-empty documents.

    A shingle counts once for each host before the shuffle too, so a phrase of a third of all pages is as cheap as any.
    """
    sent = documents.sparkSession.sparkContext.broadcast(zlib.compress(asked_for(wanted), 1))
    found = _texts(documents).mapInArrow(_explode(sent), "shingle long, host long")
    return found.distinct().groupBy("shingle").agg(F.count("*").alias("hosts"))


def spam_pages(documents: DataFrame, share: float = SHARE) -> DataFrame:
    """``(doc_id, total, evidence)`` of the pages whose evidence makes up at least ``share`` of their words."""
    pages = evidence(documents).where(~F.col("stub") & (F.col("sure") >= LISTED * F.col("total")) & (F.col("sure") + F.col("doubt") >= share * F.col("total")))
    # repeated rows are pages of their own: each is known by its values and how often it stands
    kept = pages.groupBy("doc_id", "host", "total", "sure", "doubt", "shingles").agg(F.count("*").alias("copies"))
    hosts = phrase_hosts(documents, pages.select(F.explode("shingles").alias("shingle")))
    page = ("doc_id", "host", "total", "sure", "doubt", "copies", "text")
    judged = kept.withColumn("text", F.xxhash64("shingles")).select(*page, F.explode_outer("shingles").alias("shingle")).join(hosts, "shingle", "left")
    # the page's own host is one of them
    shares = judged.groupBy(*page).agg(F.avg(F.when(F.col("hosts") > 1, 1).otherwise(0)).alias("replicated"))
    found = shares.withColumn("evidence", F.col("sure") + F.when(F.col("replicated") >= REPLICATED, F.col("doubt")).otherwise(0)).where(F.col("evidence") >= share * F.col("total"))
    return found.select("doc_id", "total", "evidence", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")

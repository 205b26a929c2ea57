"""Passages of held-out test items within a large corpus.

A document leaks an item if it contains, in order, ``passage`` consecutive words of it (all words of a shorter
item). The words are those a reader sees (:mod:`arborseek.llm.seen`).

Every item gives its passages. A window as long as the shortest of them slides over each document, and its SimHash,
64 signs of summed word hashes, is compared with those of the items' windows of that length. Equal windows have equal
fingerprints, and a multi-index finds all within ``RADIUS``: the fingerprint is cut into ``RADIUS + 1`` blocks, two
that differ in at most ``RADIUS`` bits agree in at least one block, so looking up each block loses none. What is
found is verified exactly: by the weighted shingles of the whole passage, and then word by word.

Documents stay where they are: items are few and are sent to them, in blocks of a fixed number of words where there
are many, one pass of the corpus for each block.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborseek.llm.seen import rejoined, words
from arborseek.session import written

PASSAGE = 13
RADIUS = 2
BLOCK_WORDS = 200_000  # words of items that are sent to the corpus at once, a few MB
SLICE = 16_384  # words whose fingerprints are made at once
VOCABULARY = 400_000  # words whose signs a worker keeps

_SHIFTS = np.array([0, 22, 43], np.uint64)
_WIDTHS = (22, 21, 21)


def _signs(found: list[str]) -> np.ndarray:
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in found], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def _windows(signs: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of all windows of ``length`` rows; the sums of a window double in length with every step."""
    count = len(signs) - length + 1
    total, begun, run, span = None, 0, signs, 1
    while True:
        if length & span:
            part = run[begun : begun + count]
            total, begun = (part if total is None else total + part), begun + span
        if begun == length:
            return np.packbits((total > 0).ravel()).view(np.uint64)
        run, span = run[span:] + run[:-span], 2 * span


def weighted_similarity(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Jaccard similarity of the weighted word shingles: pairs of neighbours, the ends marked, by how often they occur."""
    x, y = (Counter(zip(("", *w), (*w, ""), strict=True)) for w in (a, b))
    return sum((x & y).values()) / (sum((x | y).values()) or 1)


def anchors(lengths: set[int]) -> dict[int, int]:
    """The window length that serves each passage length: each serves all from its own up to less than its double."""
    served: dict[int, int] = {}
    anchor = 0
    for n in sorted(lengths):
        if not anchor or n >= 2 * anchor:
            anchor = n
        served[n] = anchor
    return served


class Index:
    """Fingerprint blocks of the items' windows. A passage has at most 127 words: sums of signs are bytes."""

    def __init__(self, items: list[tuple[int, str]], passage: int = PASSAGE):
        if not 0 < passage < 128:
            raise ValueError("a passage has 1 to 127 words")
        self.items = [(item, found) for item, text in items if (found := tuple(words(text)))]
        self.need = [min(passage, len(found)) for _, found in self.items]
        served = anchors(set(self.need))
        # by window length: (item, offset) of each window, and fingerprints
        spots: dict[int, list[tuple[int, int]]] = defaultdict(list)
        prints: dict[int, list[np.ndarray]] = defaultdict(list)
        for k, ((_, found), need) in enumerate(zip(self.items, self.need, strict=True)):
            length = served[need]
            made = _windows(_signs(list(found)), length)[: len(found) - need + 1]
            spots[length] += [(k, o) for o in range(len(made))]
            prints[length].append(made)
        self.tables = {}
        for length, places in spots.items():
            found = np.concatenate(prints[length])
            blocks = []
            for shift, width in zip(_SHIFTS, _WIDTHS, strict=True):
                part = (found >> shift) & np.uint64((1 << width) - 1)
                present = np.zeros(1 << width, bool)
                present[part] = True
                members = defaultdict(list)
                for i, p in enumerate(part.tolist()):
                    members[p].append(i)
                blocks.append((shift, np.uint64((1 << width) - 1), present, members))
            self.tables[length] = places, found, blocks

    def candidates(self, prints: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
        """``(position, item, offset)`` of windows within RADIUS of one of the items', each once."""
        places, found, blocks = self.tables[length]
        seen = set()
        for shift, mask, present, members in blocks:
            parts = (prints >> shift) & mask
            for at in np.flatnonzero(present[parts]).tolist():
                for i in members[int(parts[at])]:
                    if (at, i) not in seen and int(prints[at] ^ found[i]).bit_count() <= RADIUS:
                        seen.add((at, i))
                        yield at, *places[i]


def find(index: Index, texts: Iterator[tuple[int, str]]) -> Iterator[tuple[int, int, int]]:
    """``(row, item_id, word)`` of leaked items, each once for each row, with the first word of a passage."""
    known: dict[str, int] = {}
    table = np.zeros((1024, 64), np.int8)

    def ids(found: list[str]) -> np.ndarray:
        nonlocal table
        fresh = list(dict.fromkeys(w for w in found if w not in known))
        if fresh:
            if len(known) + len(fresh) > VOCABULARY:
                known.clear()
                fresh = list(dict.fromkeys(found))
            start = len(known)
            known.update(zip(fresh, range(start, start + len(fresh)), strict=True))
            while len(known) > len(table):
                table = np.concatenate([table, np.zeros_like(table)])
            table[start : start + len(fresh)] = _signs(fresh)
        return np.fromiter(map(known.__getitem__, found), np.int64, len(found))

    def scan(found: list[str], owner: np.ndarray) -> Iterator[tuple[int, int, int]]:
        places = ids(found)  # may replace the table
        signs = table.take(places, axis=0)
        for length in index.tables:
            if len(found) < length:
                continue
            for at, k, offset in index.candidates(_windows(signs, length), length):
                need, (item, own) = index.need[k], index.items[k]
                passage, window = own[offset : offset + need], tuple(found[at : at + need])
                if len(window) < need or owner[at] != owner[at + need - 1]:
                    continue
                if weighted_similarity(passage, window) == 1 and passage == window:
                    yield int(owner[at]), item, at

    reach = max(index.need, default=1)

    def flush(buffer: list[str], owner: list[int]) -> Iterator[tuple[int, int, int]]:
        # slices overlap by a passage, so that each passage lies within one
        owners = np.array(owner)
        for start in range(0, max(1, len(buffer) - reach + 1), SLICE - reach + 1):
            yield from ((row, item, start + at) for row, item, at in scan(buffer[start : start + SLICE], owners[start : start + SLICE]))

    buffer: list[str] = []
    owner: list[int] = []
    begins: dict[int, int] = {}

    def emit() -> Iterator[tuple[int, int, int]]:
        done: set[tuple[int, int]] = set()
        for row, item, at in flush(buffer, owner):
            if (row, item) not in done:
                done.add((row, item))
                yield row, item, at - begins[row]
        buffer.clear()
        owner.clear()
        begins.clear()

    for row, text in texts:
        begins[row] = len(buffer)
        whole = rejoined(text)
        for form in (text, whole) if whole is not None else (text,):
            seen = words(form)
            buffer += seen
            owner += [row] * len(seen)
            buffer.append("")  # parts one text, and one form of it, from the next
            owner.append(-1)
        if len(buffer) >= SLICE:
            yield from emit()
    yield from emit()


_made: dict[int, Index] = {}  # the index a worker used last, for the next task on the same block of items


def _index(items: list[tuple[int, str]], passage: int) -> Index:
    key = xxhash.xxh64_intdigest(repr((items, passage)))
    if key not in _made:
        _made.clear()
        _made[key] = Index(items, passage)
    return _made[key]


def _match(items: list[tuple[int, str]], passage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(items, passage)
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            hits = list(find(index, ((i, t) for i, t in enumerate(texts) if t)))
            rows = pa.array([h[0] for h in hits], pa.int64())
            yield pa.RecordBatch.from_arrays([keys.take(rows).cast(pa.int64()), pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.int32())], names=["doc_id", "item_id", "word"])

    return run


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about so many characters / 4 each, read one block at a time; an item is never divided.

    Rows without item_id or text are left out, repeated rows count once.
    """
    rows = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    size = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (4 * block_words)))
    parts = rows.withColumn("__block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for k in range(blocks):
        yield [(r["item_id"], r["text"]) for r in parts.where(F.col("__block") == k).collect()]


def leaks(documents: DataFrame, items: DataFrame, passage: int = PASSAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, item_id, word)``: each item that a row of ``documents`` leaks, with the number of a word where a passage starts.

    Null and empty texts leak nothing, items without words can't leak. Repeated documents come out each. Other
    columns are ignored. Where items make more than one block, what each pass finds is written before the next block
    is read, so that the driver never holds more than two.
    """
    texts = documents.where("length(text) > 0").select("doc_id", "text")
    found, waiting = None, None
    for block in item_blocks(items, block_words):
        if waiting is not None:
            part = written(waiting, "leaks")
            found = part if found is None else found.unionByName(part)
        waiting = texts.mapInArrow(_match(block, passage), "doc_id long, item_id long, word int")
    return waiting if found is None else found.unionByName(waiting)

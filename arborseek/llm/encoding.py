"""Encoding a corpus with a public byte-level BPE vocabulary, long texts in overlapping chunks.

Texts within ``chunk`` characters are one chunk and are encoded where they lie. Longer ones are cut into chunks
that overlap, in one pass over each text, and the chunks are written; nothing that follows touches a whole text. All
chunks are pre-tokenised in parallel; where the pre-token boundaries of two neighbours meet in their overlap, the later
chunk has fallen into step, because the pattern looks only ahead, and everything it finds from there on is what one
pass over the whole text would find. The text is stitched at those places. The piece between two of them lies within
one chunk and is cut out of it; the pieces are encoded in parallel, and their ids are put in order. Where neighbours
never meet (one run of blanks or letters longer than the overlap), the rest of the text is one piece, put together from
its chunks. Decoding concatenates the raw bytes of the ids and then reads them as UTF-8.
"""

from __future__ import annotations

import base64
import pathlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborseek.session import written

TOKENIZERS = "/opt/tokenizers"
CHUNK, OVERLAP = 8192, 256

# fixed value: the published pre-token pattern of this vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRETOKEN = regex.compile(PATTERN)
_LOOKAHEAD = 3  # characters behind a boundary that the pattern may need to see to set it

_loaded: dict[bytes, tuple[dict[bytes, int], tiktoken.Encoding]] = {}


def read_vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    """The file of ranks; it is read once on the driver and sent along, under 1 MB whatever the corpus."""
    return pathlib.Path(folder, f"{name}.tiktoken").read_bytes()


def _encoding(raw: bytes) -> tuple[dict[bytes, int], tiktoken.Encoding]:
    if raw not in _loaded:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}
        _loaded[raw] = ranks, tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[raw]


def encoder(raw: bytes) -> Callable[[str], list[int]]:
    """Ids of a text as it is; strings of special tokens are ordinary text."""
    enc = _encoding(raw)[1]

    def encode(text: str) -> list[int]:
        try:
            return enc.encode_ordinary(text)
        except BaseException as e:  # the fast matcher gives up on runs of a million blanks; this one doesn't
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return [i for m in _PRETOKEN.finditer(text) for i in enc._encode_single_piece(m[0])]

    return encode


def decode(raw: bytes, ids: list[int]) -> str:
    return _encoding(raw)[1].decode_bytes(ids).decode("utf-8")


def boundaries(chunk: str, last: bool) -> list[int]:
    """Ends of the chunk's pre-tokens, without those that text behind the chunk could still move."""
    sure = len(chunk) if last else len(chunk) - _LOOKAHEAD
    return [e for m in _PRETOKEN.finditer(chunk) if (e := m.end()) <= sure]


def stitches(heads: list[list[int]], tails: list[list[int]]) -> list[int]:
    """Where to cut: of each chunk but the first the first boundary it shares with its predecessor.

    ``heads`` and ``tails`` have, by chunk, its boundaries in the overlap with the chunk before and behind it, as
    places in the text. Behind two chunks that share none nothing is cut, since nothing is known to be in step.
    """
    cuts: list[int] = []
    for tail, head in zip(tails, heads[1:], strict=False):
        shared = set(tail) & set(head)
        if not shared:
            break
        cuts.append(min(shared))
    return cuts


def spans(cuts: list[int], chunks: int, chunk: int) -> list[tuple[int, int, int]]:
    """Of each chunk ``(piece, start, end)``: the part of the text that it gives, and to which piece.

    Up to the last cut each chunk is a piece. Those behind give what lies before the next one to the last piece.
    """
    starts = [0, *cuts]
    out = []
    for i in range(chunks):
        start = starts[i] if i < len(starts) else i * chunk
        end = cuts[i] if i < len(cuts) else (i + 1) * chunk if i + 1 < chunks else (i + 1) * chunk + chunk
        out.append((min(i, len(cuts)), start, max(start, end)))
    return out


def _encode(raw: bytes, names: list[str], types: list[pa.DataType]):
    """Rows ``(*names, text)`` to ``(*names, ids)``; null and empty texts have no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(raw)
        for b in batches:
            ids = pa.array([encode(t) if t else [] for t in b.column(len(names)).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(i).cast(t) for i, t in enumerate(types)), ids], names=[*names, "ids"])

    return run


def _cut(chunk: int, overlap: int):
    """Rows ``(row, doc_id, text)`` to ``(row, doc_id, place, last, text)``, a batch of chunks for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, doc, text in zip(*(b.column(i) for i in range(3)), strict=True):
                whole = text.as_py()
                starts = range(0, len(whole), chunk)
                n = len(starts)
                cols = [pa.array([row.as_py()] * n, pa.int64()), pa.array([doc.as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([i + 1 == n for i in range(n)], pa.bool_()), pa.array([whole[i : i + chunk + overlap] for i in starts], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "place", "last", "text"])

    return run


def _pretokenise(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, places, lasts, texts = b.column(0), *(b.column(i).to_pylist() for i in range(1, 4))
            heads, tails = [], []
            for place, last, text in zip(places, lasts, texts, strict=True):
                start = place * chunk
                found = boundaries(text, last)
                heads.append([start + e for e in found if e <= overlap])
                tails.append([start + e for e in found if e >= chunk])
            both = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([rows.cast(pa.int64()), pa.array(places, pa.int32()), pa.array(heads, both), pa.array(tails, both)], names=["row", "place", "head", "tail"])

    return run


def _stitch(chunk: int):
    """Rows ``(row, chunks)`` to ``(row, place, piece, start, end)`` of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for row, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cuts = stitches([c["head"] for c in found], [c["tail"] for c in found])
                out += [(row, place, *span) for place, span in enumerate(spans(cuts, len(found), chunk))]
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["row", "place", "piece", "start", "end"])

    return run


def encode_documents(documents: DataFrame, raw: bytes, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(doc_id, ids)``, one row for each row of ``documents(doc_id, text, ...)``.

    The text is encoded as it is. An empty text has the empty list, and so has a null one; blank texts are encoded
    like any other. Repeated rows come out as often as they go in. Other columns are ignored.
    """
    if overlap <= _LOOKAHEAD or chunk < overlap:
        raise ValueError("the overlap must exceed the pattern's look-ahead and fit into a chunk")
    long = F.char_length("text") > chunk
    short_rows = documents.where(~F.coalesce(long, F.lit(False))).select("doc_id", "text")
    short = short_rows.mapInArrow(_encode(raw, ["doc_id"], [pa.int64()]), "doc_id long, ids array<int>")

    # the written table fixes the numbers of the rows, by which all that follows is keyed
    numbered = documents.where(long).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = written(numbered.mapInArrow(_cut(chunk, overlap), "row long, doc_id long, place int, last boolean, text string"), "long-text-chunks")
    spread = chunks.select("row", "place", "last", "text").repartition("row", "place")
    found = spread.mapInArrow(_pretokenise(chunk, overlap), "row long, place int, head array<long>, tail array<long>")
    in_order = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "head", "tail"))).alias("chunks"))
    placed = in_order.mapInArrow(_stitch(chunk), "row long, place int, piece int, start long, end long")
    own = F.substring("text", (F.col("start") - F.col("place") * chunk + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    parts = chunks.join(placed, ["row", "place"]).select("row", "doc_id", "piece", "place", own.alias("text"))
    in_place = F.array_sort(F.collect_list(F.struct("place", "text")))
    pieces = parts.groupBy("row", "doc_id", "piece").agg(F.array_join(in_place["text"], "").alias("text"))
    # a null doc_id is a key like any other
    encoded = pieces.mapInArrow(_encode(raw, ["row", "doc_id", "piece"], [pa.int64(), pa.int64(), pa.int32()]), "row long, doc_id long, piece int, ids array<int>")
    whole = encoded.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("parts"))
    return short.unionByName(whole.select("doc_id", F.flatten(F.col("parts.ids")).alias("ids")))


def decode_documents(encoded: DataFrame, raw: bytes) -> DataFrame:
    """``(doc_id, text)`` of ``encoded(doc_id, ids, ...)``: the bytes of all ids put together and read as UTF-8; a null list gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if ids is None else decode(raw, ids) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")

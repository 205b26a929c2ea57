import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from arborseek.llm import encoding as e


@pytest.fixture(scope="module")
def raw():
    return e.read_vocabulary()


@pytest.fixture(scope="module")
def other():
    t = Tokenizer.from_file(f"{e.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def in_chunks(text, size, overlap):
    """The plain form of what the operator does over rows."""
    last = max(0, -(-len(text) // size) - 1)
    heads, tails = [], []
    for k in range(last + 1):
        found = e.boundaries(text[k * size : (k + 1) * size + overlap], k == last)
        heads.append([k * size + x for x in found if x <= overlap])
        tails.append([k * size + x for x in found if x >= size])
    return e.stitches(heads, tails)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab'sll \n\t 1.é日🚀", max_size=90), st.integers(8, 30), st.integers(4, 8))
def test_cuts_are_boundaries(text, size, overlap):
    true = {m.end() for m in e._PRETOKEN.finditer(text)}
    cuts = in_chunks(text, size, overlap)
    assert set(cuts) <= true and cuts == sorted(set(cuts))


SPECIAL = ["", " ", "  \n\n ", "<|endoftext|> a", "I'll they've 's", "naïve Ångström ﬁne", "日本語の文。한국어", "👩‍👩‍👧 🇪🇺", "a​b­", "\r\n\t x  y   ", "x" * 500, " " * 500, "1e-9 0xFF ½ ²", "\x00\x01"]


def test_against_second_library(spark, raw, other):
    rng = random.Random(3)
    texts = SPECIAL + ["".join(rng.choice(SPECIAL + ["word ", "Other, ", "12"]) for _ in range(60)) for _ in range(30)]
    rows = [(i, t, "x", [1]) for i, t in enumerate(texts)] + [(900, None, None, None), (None, "no id", None, None), (0, "", None, None), (901, texts[-1], None, None), (901, texts[-1], None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, ids array<int>")
    for chunk, overlap in ((64, 16), (e.CHUNK, e.OVERLAP)):
        got = e.encode_documents(df, raw, chunk, overlap).collect()
        assert len(got) == len(rows)
        named = lambda i: -1 if i is None else i
        assert sorted((named(r["doc_id"]), r["ids"]) for r in got) == sorted((named(i), other(t) if t else []) for i, t, *_ in rows)
    assert e.encode_documents(df.limit(0), raw).count() == 0


def test_round_trip_and_long(raw, other):
    encode = e.encoder(raw)
    for t in SPECIAL:
        assert e.decode(raw, encode(t)) == t
    assert e.decode(raw, encode("a" * 100_000)) == "a" * 100_000
    assert e.decode(raw, encode(" " * 1_200_000 + "x")) == " " * 1_200_000 + "x"


def test_spans_cover_the_text_once():
    for cuts in ([], [12], [12, 21], [12, 21, 33]):
        found = e.spans(cuts, 4, 10)
        assert found[0][1] == 0 and all(a[2] == b[1] or b[0] == a[0] + 1 == len(cuts) for a, b in zip(found, found[1:], strict=False))
        assert [p for p, *_ in found] == [min(i, len(cuts)) for i in range(4)]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["word ", "Other, ", "日本", "1.5 "]), st.tuples(st.sampled_from(" x\né"), st.integers(10, 400)).map(lambda p: p[0] * p[1])), min_size=8, max_size=60).map("".join))
def test_long_runs_give_what_one_pass_gives(spark, raw, text):
    df = spark.createDataFrame([(1, text), (1, text), (None, text + "!")], "doc_id long, text string")
    encode = e.encoder(raw)
    got = sorted((r["doc_id"] or 0, r["ids"]) for r in e.encode_documents(df, raw, 64, 16).collect())
    assert got == [(0, encode(text + "!")), (1, encode(text)), (1, encode(text))]


def test_ids_give_the_texts_back(spark, raw):
    rows = [(i, t) for i, t in enumerate(SPECIAL)] + [(90, None), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = e.decode_documents(e.encode_documents(df, raw, 64, 16), raw).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in got) == sorted((i or -1, t or "") for i, t in rows)
    assert e.decode_documents(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), raw).first()["text"] is None

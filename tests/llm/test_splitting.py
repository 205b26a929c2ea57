from datetime import datetime as D

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborseek.llm import splitting as s

CHUNKS = "id string, tree string, mtime timestamp, body string, tags array<string>, hierarchy array<string>, size int, piece int"
LAYERS = "tree string, layer int, max_chunk_size int, chunk_at_headings boolean, chunk_overlap int"


def check(text, size, at, overlap):
    made = s.pieces(text, size, at, overlap)
    shared = min(overlap, size - 1)
    assert all(0 < e - b <= size for b, e, _ in made)
    if not text:
        assert made == []
        return made
    assert made[0][0] == 0 and made[-1][1] == len(text)
    assert all(n[0] == p[1] - shared and n[1] > p[1] for p, n in zip(made, made[1:], strict=False))
    rebuilt = text[: made[0][1]] + "".join(text[p[1] : n[1]] for p, n in zip(made, made[1:], strict=False))
    assert rebuilt == text
    return made


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n#é́‍👩🏽🇪🇺。\r", max_size=120), st.integers(1, 40), st.booleans(), st.integers(0, 45))
def test_round_trip(text, size, at, overlap):
    check(text, size, at, overlap)


@pytest.mark.parametrize(
    ("text", "size", "at", "first"),
    [
        ("aaa\n\n# H\nbbb. ccc\n\nddd", 20, True, ("aaa\n\n", "section")),
        ("aaa\n\n# H\nbbb. ccc\n\nddd", 20, False, ("aaa\n\n# H\nbbb. ccc\n\n", "paragraph")),
        ("One two. Three four five", 20, True, ("One two. ", "sentence")),
        ("one two three four five", 10, True, ("one two ", "word")),
        ("长句子一。长句子二在这里还没有完成", 12, True, ("长句子一。", "sentence")),
        ("abcdefghij", 4, True, ("abcd", "character")),
        ("abcéfgh", 4, True, ("abc", "character")),
        ("👩‍🔬👩‍🔬", 4, True, ("👩‍🔬", "character")),
        ("```\n# no\n```\n\nxxxxxxxxxxxx", 16, True, ("```\n# no\n```\n\n", "paragraph")),
    ],
)
def test_kinds(text, size, at, first):
    made = check(text, size, at, 0)
    assert (text[: made[0][1]], made[0][2]) == first


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "e\u0301", "👩🏽", "🇪🇺", "👩\u200d🔬", "\r\n", " ", "b. "]), max_size=60).map("".join), st.integers(12, 40), st.integers(0, 4))
def test_no_piece_ends_within_a_character(text, size, overlap):
    for _, e, _ in check(text, size, True, overlap):
        assert not s.parts_character(text, e)


@pytest.mark.parametrize("overlap", [1, 2, 3])
def test_overlaps_begin_with_whole_characters_where_a_place_to_cut_allows_it(overlap):
    text = "ae\u0301b " * 40
    assert not any(s.parts_character(text, b) for b, _, _ in check(text, 11, True, overlap))


def test_where_none_does_the_overlap_stays_exact():
    text = "e\u0301" * 40
    made = check(text, 11, True, 3)  # no two places three apart are both between characters
    assert all(not s.parts_character(text, e) for _, e, _ in made) and all(s.parts_character(text, b) for b, _, _ in made[1:])
    assert len(check(text, 1, True, 0)) == 80  # a limit below a character parts it


def test_very_long():
    assert len(check("word " * 200_000, 1500, True, 200)) > 700
    assert len(check("x" * 300_000, 1000, True, 999)) > 200_000


def test_tables(spark):
    t = [D(2025, 1, i) for i in range(1, 4)]
    long = "one two three. " * 5
    rows = [
        ("a", "x", t[1], long, None, None, 0, 0),
        ("a", "x", t[1], long, None, None, 0, 0),
        ("a", "x", t[0], long * 2, None, None, 0, 0),
        ("b", "x", t[0], long, None, None, 0, 0),
        ("b", "x", t[1], "short now", None, None, 0, 0),
        ("c", "x", None, None, None, None, 0, 0),
        ("d", "other", None, "y" * 50001, None, None, 0, 0),
        ("e", None, None, long, None, None, 0, 0),
        ("f", "x", None, "z" * 30, None, None, 0, 0),
    ]
    layers = spark.createDataFrame([("x", 1, 99, True, 5), ("x", 0, 30, None, None), ("x", 0, 30, None, None), ("x", 2, 30, False, 7), ("y", 0, 0, None, -1), (None, 0, 1, None, None)], LAYERS)
    known = {r["tree"]: (r["max_chunk_size"], r["chunk_at_headings"], r["chunk_overlap"]) for r in s.effective_settings(layers).collect()}
    assert known == {"x": (30, True, 5), "y": (None, None, None)}
    df = spark.createDataFrame(rows, CHUNKS)
    got = s.split(s.oversized(df, layers)).collect()
    assert {r["id"] for r in got} == {"a", "d"}
    a = sorted((r["piece"], r["start"], r["end"], r["text"]) for r in got if r["id"] == "a")
    assert [x[1:3] for x in a] == [(b, e) for b, e, _ in s.pieces(long, 30, True, 5)] and all(long[x[1] : x[2]] == x[3] for x in a)
    assert s.oversized(df.limit(0), layers).count() == 0
    assert {r["id"] for r in s.oversized(df, layers.limit(0)).collect()} == {"d"}

import pytest

from arborseek.functions.markdown import headings, plain_inline


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("# One\n\n## Two ##\ntext\n### Three", [(1, "One"), (2, "Two"), (3, "Three")]),
        ("Title\n=====\n\nSub\n---\n", [(1, "Title"), (2, "Sub")]),
        ("#no\n####### seven\n    # code\n", []),
        ("```\n# in code\n```\n# out\n~~~\n# in\n```\n~~~", [(1, "out")]),
        ("<div>\n# in html\n\n# after", [(1, "after")]),
        ("<!-- \n# x\n-->\n# y", [(1, "y")]),
        ("> # quoted\n- # item\n# real", [(1, "real")]),
        ("---\n***\n# a `b` *c* [d](e) \\# f", [(1, "a b c d # f")]),
        ("two\nlines\n===", [(1, "twolines")]),
        ("#\n# \n## #", [(1, ""), (1, ""), (2, "")]),
        ("# crlf\r\ntext\r\n", [(1, "crlf")]),
        ("", []),
    ],
)
def test_headings(text, expected):
    assert [(h.level, h.text) for h in headings(text)] == expected


def test_spans():
    text = "é\n# A\nbody\nB\n---\nrest"
    assert [(text[h.start : h.end]) for h in headings(text)] == ["# A\n", "body\nB\n---\n"]


def test_plain_inline():
    assert plain_inline("![img](x) <b>bold</b> **s** _e_ snake_case_x `c*d*` <https://a.example>") == "img bold s e snake_case_x c*d* https://a.example"


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("> # Quoted\n> text\n", [(1, "Quoted", 2)]),
        ("- # In item\n  body\n\n  ## Deeper\n", [(1, "In item", 2), (2, "Deeper", 22)]),
        ("> - ### Both\n", [(3, "Both", 4)]),
        ("> Title\n> ===\n", [(1, "Title", 2)]),
        ("> Title\n===\n", []),
        ("- ```\n  # code\n  ```\n# Out\n", [(1, "Out", 21)]),
        ("1. a\n\n       # code of the item\n", []),
        ("* * *\n# After a rule\n", [(1, "After a rule", 6)]),
        ("- a\n# Ends the list\n", [(1, "Ends the list", 4)]),
        ("    > # indented code\n", []),
    ],
)
def test_headings_in_quotes_and_items(text, found):
    assert [(h.level, h.text, h.start) for h in headings(text, nested=True)] == found
    assert all(text[h.start : h.end].strip() for h in headings(text, nested=True))

from datetime import datetime as D

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborseek.llm import markup as m

MARKED = {
    "html": ["a <b>b</b>", "<!-- c -->", "x&nbsp;y", "&#8217;", "&lt;p&gt;", "end.<br/>", "again<br>", "<div class='x'>", "<table border=0><tr>", "<a id=\"x\"></a>T", "<BR />", "<script>var a = 1;</script>", "a<i>b</i>"],
    "latex": ["\\begin{equation}", "see~\\ref{s}", "end.\\cite{a1}", "\\item one", "$$ f(x) = 1 $$", "keep $n \\times 5$ rows", "\\[ x \\]", "$\\alpha$", "the $x$ axis", "\\emph{a} b"],
    "wiki": ["[[Page]]", "[[Page|text]]", "[https://a.example text]", "{{Stub|a=1}}", "'''b''' and ''i''", "== head ==", "{| class=x\n|-\n| a || b\n|}", "__TOC__"],
    "markdown": ["# head", "a **b** c", "a *b* c", "***b***", "~~x~~", "[t](http://u)", "![i](p.png)", "[t][r]", "[r]: http://u", "<https://u.example>", "- item", "1. item", "+ item", "> quote", "***", "a[^1]", "| a | b |\n| --- | --- |", "`code`", "```\nx\n```", "~~~sh\ny\n~~~", "Title\n=====", "_em_ x", "`<div>`", "```html\n<b>'''x'''</b> $x^2$ {{T}}\n```"],
}
PLAIN = [
    "Prices rose from $3 to $4 per seat.", "R&D paid $5 and got $10 back.", "Keep x < y and y > z.", "Vec<Entry> or Map<Key, Value>", "The Foo<T> Type", "a == b, never a = b", "done == yes", "src/**/*.rs", "5 * 3 * 2", "x ** 2",
    "C:\\temp\\new\\archive", "__init__ and __main__", "row[0][1] not row[[1]]", "see [sic] above 'as is'", "{left} and {right}", "a | b, a || b", "2^10 and x_1", "~50 ms -> 60", "#42 and issue #77", "C# for X", "3 & 4; P&L", "<ops at desk>",
    "~/notes/today_final_v2.txt", "snake_case_name", "$HOME and $PATH", "it's", "A & Co", "", " ", "a_b_c", "version 1.2.3 is out", "x <= 3", "i<b and c>d", "List<i> of ints", "-> arrow", "--flag",
]


@pytest.mark.parametrize(("family", "text"), [(f, t) for f, ts in MARKED.items() for t in ts])
def test_marked(family, text):
    assert m.families(text) == [family]
    assert m.families(f"Before that.\n\n{text}\n\nBehind it.") == [family]


@pytest.mark.parametrize("text", PLAIN)
def test_plain(text):
    assert m.families(text) == []
    assert m.clean(text) == text


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("<h2>Head</h2><p>One &amp; two<br>three</p><ul><li>a<li>b</ul>", "## Head\n\nOne & two\nthree\n\n- a\n- b"),
        ("<pre><code>let x = 1;\n</code></pre>", "```\nlet x = 1;\n\n```"),
        ("See \\emph{this} and $x^2$.\\cite{a}\n\\begin{equation}\\label{e}\n a = b\n\\end{equation}", "See this and $x^2$.\n$$a = b$$"),
        ("== Head ==\n'''b''' [[A|c]] [http://x d] {{T}}", "## Head\nb c d "),
        ("# H\n\n* a\n* **b** `c<d>`\n\n```\n<b>\n```", "# H\n\n- a\n- b c<d>\n\n```\n<b>\n```"),
        ("Vec<T> is <b>bold</b>, x < y", "Vec<T> is bold, x < y"),
        ("| a | b c |\n| --- | --- |\n| 1 | 2 |", "a\tb c\n\n1\t2"),
        ("<table><tr><td>a</td><td>b c</td></tr><tr><th>1</th><th>2</th></tr></table>", "a\tb c\n\n1\t2"),
        ("{| class=x\n|-\n| a || b c\n|}", "a \t b c"),
        ("[t](u)[^1] ~~no~~ yes\n\n[^1]: note", "t no yes\n\nnote"),
    ],
)
def test_clean(text, expected):
    assert m.clean(text) == expected


def test_content_regions():
    page = "\n".join(["<div><a href='#'>x</a></div>"] * 12 + ["<p>A long sentence of real content stands in this line of the page.</p>"] * 10 + ["<div><a href='#'>y</a></div>"] * 12)
    good = m.content_lines(page)
    assert all(good[12:22]) and not any(good[:10]) and not any(good[-10:])
    # smoothing keeps at most the lines next to the content
    words = m.clean(page).split()
    assert words.count("real") == 10 and words.count("x") <= 2 and words.count("y") <= 2
    assert m.clean("a" * 300_000 + " <b>x</b> " + "*" * 5000).endswith("*" * 5000)


def test_rows(spark):
    t = D(2025, 1, 1)
    schema = "id string, mtime timestamp, body string, tags array<string>, hierarchy array<string>, odd int, tie int"
    rows = [
        ("a", t, "<b>x</b> and `y`", None, ["plain", "''it''", None], 1, 1),
        ("a", None, "old $x^2$", None, ["# old"], 1, 1),
        ("a", t, "<b>x</b> and `y`", None, ["plain", "''it''", None], 1, 1),
        ("b", t, "**stale**", None, None, 1, 1),
        ("b", D(2025, 1, 2), "plain now", None, [], 1, 1),
        ("c", None, None, None, None, 1, 1),
        (None, t, "<i>x</i>", None, None, 1, 1),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r["id"]: (r["body_families"], r["hierarchy_families"]) for r in m.read(df).collect()}
    assert got == {"a": (["html", "markdown"], ["wiki"]), "b": ([], []), "c": ([], [])}
    texts = {r["id"]: (r["clean_body"], r["clean_hierarchy"]) for r in m.read(df, True).collect()}
    assert texts == {"a": ("x and y", ["plain", "it", None]), "b": ("plain now", []), "c": (None, None)}
    assert m.read(df.limit(0)).count() == 0


LONG = "<p>A long sentence of real content stands in this line of the page.</p>"


@pytest.mark.parametrize("glue", ["\n", ""])
@pytest.mark.parametrize("n", [5, 12])
def test_furniture_of_pages_of_any_length(glue, n):
    page = glue.join(["<div><a href='#'>x</a></div>"] * n + [LONG] * 4 + ["<div><a href='#'>y</a></div>"] * n)
    words = m.clean(page).split()
    assert words.count("real") == 4 and words.count("x") <= 2 and words.count("y") <= 2


@pytest.mark.parametrize("glue", ["\n", ""])
def test_lists_headings_code_and_formulas_stay(glue):
    kept = ["<h2>Short head</h2>", "<ul>", *["<li>two words</li>"] * 10, "</ul>", "<ol>", "<li>one</li>", "<li><p>two</p></li>", "</ol>", "<pre>x = 1</pre>", "<div>$x^2$</div>", "<table>", "<tr><td>a</td><td>b</td></tr>", "</table>"]
    got = m.clean(glue.join([*kept, *[LONG] * 10]))
    assert got.count("- two words") == 10 and "## Short head" in got and "x = 1" in got and "$x^2$" in got and "a\tb" in got
    assert "1. one" in got and "2. " in got and got.split().count("real") == 10
    assert m.clean("".join(m.pieces(glue.join(kept)))) == m.clean(glue.join(kept))


def test_text_around_html_stays():
    items = "<ul>\n" + "".join(f"  <li>Version 3.{i} made the folder lenient, and operators had to replay 605 records by hand.\n" for i in range(3)) + "</ul>"
    got = m.clean(f"See [replica][a1].\n\n{items}\n\n我们暂时不删除标题，因为查询还没有完成。\n\n![partition migration](img/a.png)\n\n{LONG}\n<div>Yes, it is.</div>")
    assert all(x in got for x in ("See replica.", "查询还没有完成。", "partition migration", "Yes, it is.")) and got.count("- Version") == 3


@pytest.mark.parametrize(("text", "cleaned"), [('A <img src="x"alt="y"> b.', "A  b."), ("x &copy 2024", "x © 2024"), ("5 &lt 6", "5 < 6")])
def test_forms_only_a_parser_sees(text, cleaned):
    assert m.families(text) == ["html"] and m.clean(text) == cleaned


@pytest.mark.parametrize("text", ["http://a.test/?x=1&copy=2&lt=3", "R&D, AT&T", "a &notit b", 'say "x"y > z'])
def test_no_forms_of_a_parser(text):
    assert m.families(text) == []


PARTS = st.one_of(st.text("ab \n\ue000\ue001\ue0020123", max_size=12), st.sampled_from(["`x\ue0000\ue001`", "$x^2$", "<b>b</b>", "**s**", "```\n\ue0007\ue001\n```", "$$a\n= `b`$$", "\\begin{verbatim}`c`\\end{verbatim}", "&amp;", "\\item `d`"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=8).map(" ".join))
def test_private_use_characters_are_text(text):
    got = m.clean(text)
    held = lambda x: [c for c in x if "\ue000" <= c <= "\uf8ff"]
    assert held(got) == held(text)


def test_all_private_use_characters_of_the_plane():
    every = "".join(map(chr, range(0xE000, 0xF900)))
    assert m.clean(f"{every} `x` **b**") == f"{every} x b"


@pytest.mark.parametrize("n", [1, 199, 200, 201, 500, 20_000])
def test_formulas_of_any_length(n):
    formula = "$x^2 + " + "y" * n + "$"
    assert m.families(f"See {formula} here.") == ["latex"]
    assert m.clean(f"See {formula} and <b>b</b>.") == f"See {formula} and b."


def test_code_within_a_formula_comes_back():
    assert m.clean("$$a `b` c$$ **d**") == "$$a b c$$ d"


def test_the_time_of_long_texts_grows_with_their_length():
    began = time.time()
    for text in ("<!-- " + "x < y & z " * 100_000, "a <" * 200_000, "$x " * 200_000, "&" * 400_000, "Vec<i> " * 100_000):
        m.families(text)
    assert time.time() - began < 20


def test_events_look_at_what_stands_around_a_tag():
    assert m.families("a List<i> of " + "x " * 5000 + "ints</i>") == ["html"]
    assert m.families("a\nList<i> of\nints\nand Map<a, b>") == []
    assert m.families("a\nb\nList<i class=x> of") == ["html"]

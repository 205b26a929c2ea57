import pytest

from arborseek.llm import stuffing as ops

SENTENCES = "The team keeps a short list of open questions, and it is read every week. Nobody has changed the rule since it was written down. When a page grows too long, we cut it at the next heading.\n\n"
NAMES = "anvil kettle lantern quilt saddle barrel ladder raft mosaic orchard hammock thimble".split()
SPAM = {
    "keyword": "cache Cache CACHE caches cache " * 20,
    "phrase": " ".join(f"{a} tin kettle" for a in ["buy", "cheap", "best", "online"] * 10),
    "pseudo": "tin kettle or tin kettle? tin kettle means tin kettle. Get tin kettle, love tin kettle! " * 6,
    "names": "\n".join(f"{n.title()} tin kettle" for n in NAMES),
    "bars": " | ".join(f"{n.title()} tin kettle" for n in NAMES),
    "links": "\n".join(f"- [{n} page](https://{n}.example/{n}?id=3)" for n in NAMES),
    "wiki": "\n".join(f"{i}. [[{n} {n}s]] / [https://{n}.example/x {n}]" for i, n in enumerate(NAMES)),
    "html": "<ul>\n" + "\n".join(f"<li><a href='https://{n}.example' title='x'>read more</a></li>" for n in NAMES) + "\n</ul>",
    "few links": "<ul>\n" + "\n".join(f"<li><a href='https://{n}.example'>{n} {n}s</a></li>" for n in NAMES[:6]) + "\n</ul>",
    "urls": "\n\n".join(f"http://{n}.example/{n}.html" for n in NAMES * 2),
    "tags": " ".join(f"#{n}{m}" for n in NAMES for m in NAMES[:2]),
    "attributes": "\n".join(f"{k}: {', '.join(NAMES)}" for k in ("Brand", "Colour", "SKU")),
    "list": ", ".join(NAMES * 3),
    "mixed": "Keep the kettle clean.\n\n" + ", ".join(NAMES * 3),
    "doorway": "\n\n".join(f"## best tin kettle\ntin kettle {n}, {n}s, saddle https://{n}.example" for n in NAMES),
}
PLAIN = {
    "sentences": SENTENCES * 4,
    "link section": SENTENCES + "## See also\n\n" + "\n".join(f"- [{n}](https://{n}.example)" for n in NAMES),
    "glossary": "\n".join(f"{n.title()}: A thing that a careful owner keeps in the house for years." for n in NAMES),
    "changelog": "\n".join(f"- 1.{i}.0: The {n} was mended after a report from the field." for i, n in enumerate(NAMES)),
    "parameters": "\n".join(f"* `{n}_path` (str): Where the {n} of the house is kept." for n in NAMES),
    "table": "| name | state |\n| --- | --- |\n" + "\n".join(f"| {n} | idle |" for n in NAMES * 3),
    "log": "\n".join(f"2025-01-{i + 10} WARN {n} retry {i} of 9" for i, n in enumerate(NAMES)),
    "code": "```python\n" + "\n".join(f'{n} = load("{n}", limit=3)' for n in NAMES * 3) + "\n```",
    "awesome": "\n".join(f"- [{n}](https://{n}.example) - A {n} that every house in the valley should have." for n in NAMES),
    "chinese": "设置决定是否保留章节。如果查询超过条，就应当比较模板。\n\n本节说明如何合并日志以及日志为什么重要。",
    "one sentence again": " ".join(f"After the note {n}, the key of the {a} stayed unfinished until the change came." for n, a in enumerate(NAMES[:6] * 2)),
    "breaks": "<p>" + "<br/>".join("Why does the kettle of the mason stand on the wall and who will carry it home again to the valley".split()) + "</p>\n",
    "references": "&nbsp;".join(("In the village every mason who owns a kettle must also mend the lantern that belongs to the oldest tailor " * 2).split()),
    "stub": "# Kettle\n\nkettle, pot",
    "mostly text": SENTENCES * 2 + ", ".join(NAMES * 2),
    "verse": "Why does the kettle of the mason stand on the wall\nand who of the guests will carry it home again\n" * 3,
}


def share(text):
    page = ops.Page(text)
    return page.sure / page.total if page.total >= ops.FEWEST or page.links >= ops.LINKS else 0


@pytest.mark.parametrize("kind", SPAM)
def test_spam(kind):
    assert share(SPAM[kind]) >= ops.SHARE


@pytest.mark.parametrize("kind", PLAIN)
def test_plain(kind):
    assert share(PLAIN[kind]) < ops.SHARE


def test_pages(spark):
    doubtful = "the kettle and the lantern of our village are for sale at any time of the day here"
    half = ", ".join(NAMES) + "\n" + doubtful
    rows = [(i, t, "a") for i, t in enumerate([*SPAM.values(), *PLAIN.values()])]
    rows += [(100, half, "a"), (101, half, "b"), (101, half, "b"), (102, half.replace("kettle", "jug").replace("sale", "rent").replace("time", "hour"), "a"), (103, None, None), (104, "", "a"), (105, " \n ", "b"), (0, SPAM["keyword"], "a")]
    rows.append((106, "word " * 400_000, None))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(r["doc_id"] for r in ops.spam_pages(df).collect())
    assert got == sorted([*range(len(SPAM)), 0, 100, 101, 101, 106])
    assert ops.spam_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("place", ["sentence", "heading", "table", "stub"])
def test_phrases_of_all_lines_count(spark, place):
    doubtful = "the kettle and the lantern of our village are for sale at any time of the day here"
    half = ", ".join(NAMES) + "\n" + doubtful
    copy = {"sentence": f"{SENTENCES}{doubtful}.", "heading": f"# {doubtful}\n\n{SENTENCES}", "table": f"| {doubtful} | x |\n\n{SENTENCES}", "stub": " ".join(doubtful.split()[:13])}[place]
    schema = "doc_id long, text string, source string"
    assert ops.spam_pages(spark.createDataFrame([(1, half, "a"), (2, copy, "a")], schema)).count() == 0
    assert [r["doc_id"] for r in ops.spam_pages(spark.createDataFrame([(1, half, "a"), (2, copy, "b")], schema)).collect()] == [1]


def test_phrases_enter_pages_of_list_evidence(spark):
    mostly = ", ".join(NAMES * 4) + "\nthe kettle and the lantern of our village"
    schema = "doc_id long, text string, source string"
    (row,) = ops.spam_pages(spark.createDataFrame([(1, mostly, "a"), (2, "# the kettle and the lantern of our village", "b")], schema)).collect()
    assert (row["total"], row["evidence"]) == (56, 56)


@pytest.mark.parametrize("phrases", [5, 8, 20])
def test_rotated_keywords(phrases):
    made = [f"{a} {b} {c}" for a, b, c in zip(NAMES * 2, [*NAMES[5:], *NAMES[:5]] * 2, ["shop", "price", "deal", "sale"] * 6)][:phrases]
    assert share(" ".join(made * 20)) >= ops.SHARE
    assert share("\n".join(made * 20)) >= ops.SHARE
    assert share(SENTENCES * 20 + " ".join(made * 5)) < ops.SHARE


def test_set_forms_are_not_rotated_keywords():
    rows = "\n".join(f"| kettle {n} |" for n in NAMES * 5)
    steps = "\n".join("The kettle of the mason stands on the wall of the garden." for _ in range(12))
    assert share(rows) < ops.SHARE and share(steps) < ops.SHARE


def test_stitched_pages_are_found_by_phrases_alone(spark):
    """Pages of other hosts' phrases under a list are spam; the same without those hosts, or with the phrases as sentences, are not."""
    phrases = [f"the {a} and the {b} of our village for sale all day" for a, b in zip(NAMES, [*NAMES[3:], *NAMES[:3]], strict=True)]
    stitched = "\n".join([", ".join(NAMES * 2), *phrases[:4]])
    sentences = "\n".join([", ".join(NAMES * 2), *(f"{p}." for p in phrases[:5])])
    schema = "doc_id long, text string, source string"
    others = [(10 + i, f"{SENTENCES}{p}.", f"host{i % 3}") for i, p in enumerate(phrases)]
    rows = [(1, stitched, "own"), (2, sentences, "own"), (3, stitched.replace(" and the ", " or a ").replace("of our village", "in a valley").replace("sale all day", "rent by week"), "own"), *others]
    found = lambda rows: sorted(r["doc_id"] for r in ops.spam_pages(spark.createDataFrame(rows, schema)).collect())
    assert found(rows) == [1] and found(rows[:3]) == []


def test_hosts_are_counted_exactly(spark):
    texts = {1: ("a", "one two three four five six"), 2: ("b", "zero one two three four five\none two three four five"), 3: ("b", "one two three four five"), 4: (None, "two three four five six"), 5: ("", "two three four five six"), 6: ("c", None)}
    df = spark.createDataFrame([(d, t, h) for d, (h, t) in texts.items()], "doc_id long, text string, source string")
    wanted = [int(x) for w in ("one two three four five", "two three four five six", "zero one two three four", "six five four three two") for x in ops.shingles([w.split()])]
    got = {r["shingle"]: r["hosts"] for r in ops.phrase_hosts(df, spark.createDataFrame([(w,) for w in wanted], "shingle long")).collect()}
    assert [got.get(w) for w in wanted] == [2, 2, 1, None]
    bits = ops.asked_for(spark.createDataFrame([(w,) for w in (-1, 0, 1 << 62)], "shingle long"))
    assert sum(x.bit_count() for x in bits) == 3 and bits[0] == 1 and bits[-1] == 128 and len(bits) == 1 << (ops.FILTER_BITS - 3)

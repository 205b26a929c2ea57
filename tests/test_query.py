import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborseek.functions.stem import stem, stemmer
from arborseek.query.ast import And, Boost, Field, Not, Or, Phrase, Term, all_of, any_of, leaf_terms, to_query, tree_lines
from arborseek.query.parser import QueryError, join_queries, lex, parse

T = Term


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("rust", T("rust")),
        ("rust async", And((T("rust"), T("async")))),
        ("rust async OR golang", Or((And((T("rust"), T("async"))), T("golang")))),
        ("a or b", Or((T("a"), T("b")))),
        ('"error handling"', Phrase(("error", "handling"))),
        ('"one"', T("one")),
        ('""', T("")),
        ("-foo", Not(T("foo"))),
        ("--foo", Not(Not(T("foo")))),
        ("error-handling", T("error-handling")),
        ("(rust OR golang) async", And((Or((T("rust"), T("golang"))), T("async")))),
        ("((a OR b) c)", And((Or((T("a"), T("b"))), T("c")))),
        ('title:"getting started"', Field("title", Phrase(("getting", "started")))),
        ("title:(rust OR golang)", Field("title", Or((T("rust"), T("golang"))))),
        ("title:guide^2.5", Boost(Field("title", T("guide")), 2.5)),
        ("(rust async)^2.0", Boost(And((T("rust"), T("async"))), 2.0)),
        ("a (b c)", And((T("a"), T("b"), T("c")))),
        ("   ", None),
        ("", None),
    ],
)
def test_parse(query, expected):
    assert parse(query) == expected


@pytest.mark.parametrize(("query", "position"), [('a "b', 2), ("^2.5", 0), ("rust^", 4), ("rust^abc", 4), ("(a", 2), ("a)", 1), ("OR a", 0), ("a OR", 4), ("title:-x", 6), ("-", 1), ("()", 1)])
def test_errors(query, position):
    with pytest.raises(QueryError) as e:
        parse(query)
    assert e.value.position == position and "^" in str(e.value)


leaf = st.one_of(st.sampled_from("abc").map(Term), st.lists(st.sampled_from("xyz"), min_size=2, max_size=3).map(lambda w: Phrase(tuple(w))))
exprs = st.recursive(leaf, lambda c: st.one_of(st.lists(c, min_size=2, max_size=3).map(lambda x: all_of(*x)), st.lists(c, min_size=2, max_size=3).map(lambda x: any_of(*x)), c.map(Not), c.map(lambda x: Boost(x, 2.5)), leaf.map(lambda x: Field("body", x))), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(exprs)
def test_round_trip(e):
    assert parse(to_query(e)) == e
    assert tree_lines(e)


def test_helpers():
    assert join_queries(["a b", " ", "c"]) == "(a b) OR (c)" and join_queries(["a"]) == "a"
    assert leaf_terms(parse('a -b "c d" body:e^2')) == ["a", "b", "c", "d", "e"]
    assert [t.kind for t in lex("a:b -c ^1")] == ["field", "term", "not", "term", "boost"]


@pytest.mark.parametrize(
    ("word", "expected"),
    [("handling", "handl"), ("running", "run"), ("programs", "program"), ("programming", "program"), ("caresses", "caress"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("generously", "generous"), ("national", "nation"), ("happy", "happi"), ("say", "say"), ("by", "by"), ("skies", "sky"), ("sensational", "sensat"), ("operators", "oper"), ("agreed", "agre"), ("luxuriated", "luxuri")],
)
def test_stem(word, expected):
    assert stem(word) == expected


@pytest.mark.parametrize(
    ("language", "pairs"),
    [
        ("german", "aufeinander aufeinand kategorie kategori kategorisch kategor katers kat häuser haus laufen lauf möglichkeit moglich bedürfnissen bedurfnis größe gross freundlichkeit freundlich"),
        ("spanish", "cheque chequ chicas chic torneado torn torniquetes torniquet tortuga tortug chilenos chilen totalmente total torrenciales torrencial rápidamente rapid comprándolo compr"),
        ("danish", "indtage indtag indtagelse indtag undersøgelse undersøg undersøgelsen undersøg hus hus"),
        ("norwegian", "havnedistriktene havnedistrikt havnemyndighetene havnemynd havnemyndigheter havnemynd opning opning"),
        ("swedish", "jakt jakt jakten jakt klokare klok kloka klok klokast klok klokheten klok"),
        ("french", "continua continu continuait continu continuation continu continuellement continuel majestueusement majestu majesté majest majeur majeur maintenaient mainten contentement content constamment const"),
    ],
)
def test_published_vocabularies(language, pairs):
    words = pairs.split()
    assert [stemmer(language)(w) for w in words[::2]] == words[1::2]
    assert [stemmer(language)(w) for w in ("", "a", "é", "ß", "y" * 30)]


def test_languages():
    assert stemmer("None")("x") == "x"
    with pytest.raises(ValueError):
        stemmer("klingon")

import random

import numpy as np
import pytest

from arborseek.llm import leakage as ops
from arborseek.llm.seen import words

ITEM = "In the village of Harrowfen, every glazier who owns a speckled anvil must also repair the canal that belongs to the oldest naïve ﬁsher. Ärger 12!"


@pytest.mark.parametrize(
    "form",
    [
        ITEM.upper(),
        ITEM.replace(" ", "\n> "),
        ITEM.replace("speckled", "spec​kled").replace("glazier", "gla­zier"),
        ITEM.replace("glazier", "<b>gla</b>zier").replace(" ", "&nbsp;"),
        ITEM.replace(" ", "<br/>"),
        ITEM.replace("every", "**every**").replace("canal", "c**an**al").replace("oldest", "*oldest*").replace("owns", "_owns_"),
        ITEM.replace("anvil", "[anvil](http://a.example/x)").replace("canal", "[[Canal page|canal]]"),
        ITEM.replace("naïve", "naïve").replace("Ä", "&Auml;").replace("speckled", "ｓｐｅｃｋｌｅｄ"),
        ITEM.replace("repair", "re-\n  pair").replace(",", " – “"),
        "// " + ITEM.replace("who ", "who\n// "),
        ITEM.replace("<", "").replace("anvil", "\\textbf{anvil}"),
    ],
)
def test_forms(form):
    want = words(ITEM)
    index = ops.Index([(7, ITEM)])
    assert list(ops.find(index, iter([(0, "before " + form + " behind")])))[0][:2] == (0, 7)
    if "re-\n" not in form:
        assert words(form) == want


def brute(docs, items, passage):
    out = set()
    for d, text in docs:
        w = words(text or "")
        for i, item in items:
            v = words(item or "")
            n = min(passage, len(v))
            grams = {tuple(v[o : o + n]) for o in range(len(v) - n + 1)} if n else set()
            if any(tuple(w[o : o + n]) in grams for o in range(len(w) - n + 1)):
                out.add((d, i))
    return out


def test_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(25)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, some(rng.choice([1, 2, 3, 5, 8, 9, 13, 14, 40]))) for i in range(40)] + [(90, "!!"), (91, None), (None, "w1"), (0, None), (92, "")]
    docs = []
    for d in range(150):
        text = some(rng.randrange(0, 60))
        if rng.random() < 0.6:
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(0, max(1, len(w)))
            text += " " + " ".join(w[a : a + rng.randrange(1, 20)]) + ". " + some(rng.randrange(0, 30))
        docs.append((d, text))
    docs += [(200, None), (201, ""), (202, "   "), (203, " ".join(vocabulary) * 3000 + " " + items[8][1])]
    known = [(i, t) for i, t in items if i is not None and t]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, item_id int")
    idf = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    for passage, block in ((13, 10**6), (5, 20)):
        got = [(r["doc_id"], r["item_id"]) for r in ops.leaks(df, idf, passage, block).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(docs, known, passage)
    assert len(list(ops.item_blocks(idf, 20))) > 1
    assert ops.leaks(df, idf.limit(0)).count() == 0 and ops.leaks(df.limit(0), idf).count() == 0


def test_near_fingerprints_are_candidates():
    rng = np.random.default_rng(1)
    index = ops.Index([(1, " ".join(f"a{i}" for i in range(40)))])
    (length, (_, prints, _)), = index.tables.items()
    for bits in range(ops.RADIUS + 1):
        changed = prints.copy()
        for k in range(len(changed)):
            for bit in rng.choice(64, bits, replace=False):
                changed[k] ^= np.uint64(1) << np.uint64(bit)
        hit = {(at, offset) for at, _, offset in index.candidates(changed, length)}
        assert {(k, k) for k in range(len(changed))} <= hit


def test_anchors():
    assert ops.anchors({13}) == {13: 13}
    assert ops.anchors({1, 2, 3, 7, 8, 13}) == {1: 1, 2: 2, 3: 2, 7: 7, 8: 7, 13: 7}

"""Stemming over distinct words only: English by the published Porter2 rules here, other languages in ``snowball``."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborseek.functions.snowball import danish, french, german, norwegian, spanish, swedish

# fixed values: the exceptions and endings of the published algorithm
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al",
    "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]

_V = "aeiouy"
_STEMMERS = {"none": lambda w: w, "danish": danish, "french": french, "german": german, "norwegian": norwegian, "spanish": spanish, "swedish": swedish}
LANGUAGES = (*_STEMMERS, "english")


def _regions(w: str) -> tuple[int, int]:
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if r1 is None:
        m = re.search(f"[{_V}][^{_V}]", w)
        r1 = m.end() if m else len(w)
    m = re.search(f"[{_V}][^{_V}]", w[r1:])
    return r1, r1 + m.end() if m else len(w)


def _short(w: str) -> bool:
    return bool(re.search(f"(?:^[{_V}][^{_V}]|[^{_V}][{_V}][^{_V}wxY])$", w))


def stem(word: str) -> str:
    """The stem of a lower-cased English word; words of up to two letters are their own."""
    if len(word) <= 2:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = word.removeprefix("'")
    w = re.sub(f"(^|[{_V}])y", r"\1Y", w)
    r1, r2 = _regions(w)
    w = re.sub("'s?'?$", "", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}].", w[:-1]):
        w = w[:-1]
    if w in _KEPT:
        return w.lower()
    # past forms
    m = re.search("(eedly|eed)$", w)
    if m:
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search("(ingly|edly|ing|ed)$", w)) and re.search(f"[{_V}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif len(w) <= r1 and _short(w):
            w += "e"
    w = re.sub(f"(?<=.[^{_V}])[yY]$", "i", w)
    # longer endings
    for end, new in _STEP2.items():
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: len(w) - len(end)] + new
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l" or re.search("[cdeghkmnrt]li$", w) and len(w) - 2 >= r1:
            w = w[:-1] if w.endswith("ogi") else w[:-2]
    for end, new in _STEP3.items():
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: len(w) - len(end)] + new
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2:
                w = w[: len(w) - len(end)]
            break
    else:
        if re.search("[st]ion$", w) and len(w) - 3 >= r2:
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def stemmer(language: str):
    """The word function of a language; ``none`` keeps words. Others raise rather than silently not stem."""
    name = language.lower()
    if name not in LANGUAGES:
        raise ValueError(f"unsupported stemmer language: {language}")
    return stem if name == "english" else _STEMMERS[name]


def stem_column(df: DataFrame, column: str, language: str) -> DataFrame:
    """``df`` with ``column`` stemmed. Each distinct word is stemmed once and joined back."""
    word = stemmer(language)
    if language.lower() == "none":
        return df

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"__word": b["__word"], "__stem": b["__word"].map(word)})

    stems = df.select(F.col(column).alias("__word")).where("__word is not null").distinct().mapInPandas(run, "__word string, __stem string")
    return df.join(stems, F.col(column) == F.col("__word"), "left").withColumn(column, F.col("__stem")).drop("__word", "__stem")


def stem_words(column: str, language: str) -> Column:
    """An array of words with each word stemmed. A worker stems a word once, as long as it keeps a bounded number of them."""
    word = stemmer(language)
    if language.lower() == "none":
        return F.col(column)
    known: dict[str, str] = {}

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        def stem_of(w: str) -> str:
            if w not in known:
                if len(known) > 500_000:
                    known.clear()
                known[w] = word(w)
            return known[w]

        return texts.map(lambda ws: None if ws is None else [stem_of(w) for w in ws])

    return run(column)

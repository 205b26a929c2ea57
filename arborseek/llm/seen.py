"""Words of a text as a reader sees them: without case, punctuation, typography, inline markup, invisible characters."""

from __future__ import annotations

import html
import re
import unicodedata

# fixed values: HTML elements that don't part a word
_INLINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr".split()
_BLOCK = (
    "address article aside blockquote body br button canvas caption center col colgroup dd details dialog div dl dt "
    "fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe img input li "
    "link main menu meta nav noscript ol optgroup option p param picture pre script section select source style summary "
    "table tbody td template textarea tfoot th thead title tr track ul video"
).split()
_TAG = re.compile(r"<!--.*?(?:-->|$)|</?(?:(" + "|".join(_INLINE) + ")|(?:" + "|".join(_BLOCK) + r"))(?=[\s>/])[^<>]*>", re.I | re.S)
_LINK = re.compile(r"\]\([^()\s]*(?:[ \t]+(?:\"[^\"]*\"|'[^']*'))?\)")  # the target behind a link's text
_WIKI = re.compile(r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]")
_LATEX = re.compile(r"\\(?:emph|text[a-z]{2,4}|underline|uline|mbox)\{([^{}]*)\}")
_MARKS = re.compile(r"[*~`]+")
# fixed values: characters that show nothing and part nothing
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff]")
_WORD = re.compile(r"[^\W_]+")
_BROKEN = re.compile(r"[-‐][^\S\n]*\n[\s>#/*|%;]*(?=[^\W\d_])")


def _within_word(m: re.Match) -> str:
    """Emphasis marks within a word go, others part words."""
    before, behind = m.string[m.start() - 1 : m.start()], m.string[m.end() : m.end() + 1]
    return "" if before.isalnum() and behind.isalnum() else " "


def shown(text: str) -> str:
    """The text without what a reader doesn't see, case-folded and in compatibility form."""
    if "<" in text:
        text = _TAG.sub(lambda m: "" if m[1] else " ", text)
    if "&" in text:
        text = html.unescape(text)
        if "<" in text:
            text = _TAG.sub(lambda m: "" if m[1] else " ", text)
    if "](" in text:
        text = _LINK.sub(" ", text)
    if "[[" in text:
        text = _WIKI.sub(r"\1", text)
    if "\\" in text:
        text = _LATEX.sub(r"\1", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
        text = _INVISIBLE.sub("", text)
    if "*" in text or "~" in text or "`" in text:
        text = _MARKS.sub(_within_word, text)
    text = text.casefold()
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def words(text: str) -> list[str]:
    return _WORD.findall(shown(text))


def rejoined(text: str) -> str | None:
    """The text with words joined that a line end divides at a hyphen; None if there are none."""
    return _BROKEN.sub("", text) if "\n" in text and _BROKEN.search(text) else None

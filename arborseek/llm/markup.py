"""Markup residue in texts: which kinds a text holds, and the clean text without it.

Markdown code spans and blocks are set aside first, since what stands in them counts for no other kind. What is left
goes through the streaming HTML parser of the standard library, whose events (tags, comments, declarations, character
references) make up the family ``html``; the standard library has no parser for the other families, which are scanned
for their own forms. Look-alikes of running text (prices, comparisons, type parameters, operators, globs, file names,
identifiers, indices) are ruled out by what stands around an event or form. Clean text is made of the same parser's
events; headings, lists, code and formulas stay, in plain form, and cells of tables are parted by tabs.

Where a body is HTML, of any length, it is cut at line ends and block tags, and lines of content are told from lines of
page furniture by their text-to-tag ratio: the ratios are smoothed by a Gaussian, and the lines above a threshold of
their spread form the content regions. Headings, list items, table rows, code and formulas stay wherever they are.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborseek.operators.current import newest_rows

FAMILIES = ("html", "latex", "wiki", "markdown")

# --- fixed values -----------------------------------------------------------------------------------------------
HTML_NAMES = (
    "a abbr acronym address area article aside audio b base bdi bdo big blockquote body br button canvas caption center "
    "cite code col colgroup data dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer "
    "form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map "
    "mark menu meta nav noscript object ol optgroup option p param picture pre q ruby s samp script section select small "
    "source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr tt "
    "u ul var video wbr"
).split()
VOID_NAMES = "area base br col embed hr img input link meta param source wbr".split()
# commands that are LaTeX even without an argument in braces
LATEX_NAMES = (
    "item maketitle tableofcontents noindent par newline linebreak newpage clearpage hline centering bf it em tt sc rm small "
    "large Large huge alpha beta gamma delta epsilon varepsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau "
    "upsilon phi varphi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega sum prod int frac sqrt times cdot "
    "leq geq neq approx equiv infty partial nabla rightarrow leftarrow Rightarrow to in notin subset cup cap forall exists "
    "ldots cdots dots quad qquad LaTeX TeX left right pm mp div"
).split()
MAGIC_WORDS = "TOC NOTOC FORCETOC NOEDITSECTION NEWSECTIONLINK NONEWSECTIONLINK NOGALLERY HIDDENCAT INDEX NOINDEX STATICREDIRECT NOTITLECONVERT NOCONTENTCONVERT DISAMBIG".split()
# ----------------------------------------------------------------------------------------------------------------

_NAME = "(?:" + "|".join(sorted(HTML_NAMES, key=len, reverse=True)) + ")"
_ATTR = r"""(?:(?:\s+|(?<=["']))[a-zA-Z_:@][\w:.@-]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?)*"""
_TAG = re.compile(rf"<(/?)({_NAME}){_ATTR}\s*/?>", re.I)
_NAMES = frozenset(HTML_NAMES)
_COMMENT = re.compile(r"<!--.*?-->|<!DOCTYPE\s[^<>]*>|<!\[CDATA\[", re.S | re.I)
_LEGACY = re.compile(r"&(" + "|".join(sorted((x for x in html5 if not x.endswith(";")), key=len, reverse=True)) + r")(?![\w=;&])")
_ENTITY = re.compile(r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")

_FENCED = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n]*\n(?:.*?^ {0,3}\1[`~]*[ \t]*$|.*\Z)", re.S | re.M)
_SPAN = re.compile(r"(?<!`)(`{1,2})(?!`)((?:(?!\n\s*\n).)+?)(?<!`)\1(?!`)", re.S)

_COMMAND = re.compile(r"(?<![\w:\\/.])\\([a-zA-Z]+)\*?(?=\s*[\[{]|)")
_BRACED = re.compile(r"(?<![\w:\\/])\\[a-zA-Z]+\*?(?:\[[^\[\]\n]*\])?\{")
_BRACED_AFTER_WORD = re.compile(r"(?<=\w)\\(?:cite[a-z]*|ref|eqref|label|footnote|emph|text[a-z]{2})\*?(?:\[[^\[\]\n]*\])?\{")
_BARE = re.compile(r"(?<![\w:\\/])\\(?:" + "|".join(LATEX_NAMES) + r")(?![a-zA-Z\\])")
_DISPLAY = re.compile(r"\$\$(?=\s*\S)(?:(?!\n\s*\n)[^$])+\$\$|\\\[(?:(?!\n\s*\n).)+?\\\]|\\\((?:(?!\n\s*\n).)+?\\\)", re.S)
_DOLLARS = re.compile(r"(?<![\w\\$])\$(?![\s$])((?:[^$\n\\]|\\.)*?)(?<![\s\\])\$(?![\w$])")
_MATH = re.compile(r"\\[a-zA-Z]|[\^_=+<>]|^[a-zA-Z]'?$|[a-zA-Z]\s*[-*/(]\s*[\w(]|^\d*[a-zA-Z]$")

_WIKI_LINK = re.compile(r"(?<![\w\])\[])\[\[(?![\s\[\]])(?=[^\[\]\n]*[^\W\d_])[^\[\]\n]+(?<!\s)\]\](?!\])")
_WIKI_EXT = re.compile(r"(?<!\])(?<!!)\[(?:https?:|ftp:)?//[^\s\[\]]+(?:\s+[^\[\]\n]*)?\](?![(\[])")
_TEMPLATE = re.compile(r"(?<![{$%\w])\{\{(?![{\s%])[^{}]*(?:\{\{[^{}]*\}\}[^{}]*)*\}\}(?!\})")
_QUOTES = re.compile(r"(?<!')('{5}|'{3}|'{2})(?!')(?=\S)((?:(?!'{2})[^\n])+?)(?<=\S)\1(?!')")
_EQUALS = re.compile(r"^[ \t]*(={1,6})[ \t]*(?![=\s])([^\n]*?[^\s=])[ \t]*\1[ \t]*$", re.M)
_WIKI_TABLE = re.compile(r"^[ \t]*\{\|(?![|}])|^[ \t]*\|\}[ \t]*$|^\|-[ \t]*$", re.M)
_MAGIC = re.compile(r"(?<![\w])__(?:" + "|".join(MAGIC_WORDS) + r")__(?!\w)|\{\{(?:PAGENAME|SITENAME|CURRENTYEAR|FULLPAGENAME)\}\}|^#REDIRECT\s*\[\[", re.M)

_IMAGE = re.compile(r"!\[[^\[\]\n]*\](?:\([^()\s]*(?:\s+[\"'][^\n]*?[\"'])?\)|\[[^\[\]\n]*\])")
_LINK = re.compile(r"(?<![\w\])!])\[(?!\^)((?:[^\[\]\n]|\[[^\[\]\n]*\])+)\]\(<?[^()\s<>]*(?:\([^()\s]*\)[^()\s]*)*>?(?:\s+[\"'(][^\n]*?[\"')])?\)")
_REFERENCE = re.compile(r"(?<![\w\])])\[(?!\^)[^\[\]\n]*[^\W\d_][^\[\]\n]*\]\s?\[[^\[\]\n]*\]")
_DEFINITION = re.compile(r"^ {0,3}\[[^\[\]\n]+\]:[ \t]*\S+", re.M)
_AUTOLINK = re.compile(r"<(?:(?:https?|ftp):[^<>\s]+|mailto:[^<>\s]+|[\w.+-]+@[\w-]+\.[\w.-]+)>", re.I)
_FOOTNOTE = re.compile(r"\[\^[^\[\]\s]+\]")
_STRONG = re.compile(r"(?<![\w*\\/])(\*{1,3})(?![\s*/.])((?:(?!\n\s*\n)[^*])+?)(?<![\s*/\\])\1(?![\w*/])")
_INNER = re.compile(r"(?<=[^\W\d_])(\*{2,3})(?=[^\W_])([^*\n]+?)(?<=[^\W_])\1(?!\*)|(?<![\w*\\/])(\*{2,3})(?=[^\W_])([^*\n]+?)(?<=[^\W_])\3(?=[^\W\d_])")
_UNDER = re.compile(r"(?<![\w\\/.])(_{1,2})(?=[^\W_])([^_\n]*?)(?<=[^\W_])\1(?![\w/(.])")
_STRIKE = re.compile(r"(?<![~\w])~~(?![\s~])([^~\n]+?)(?<!\s)~~(?!~)")
_ITEM = re.compile(r"^[ \t>]*(?:[-*+][ \t]+(?=\S)|\d{1,9}[.)][ \t]+(?=\S))", re.M)
_QUOTE = re.compile(r"^ {0,3}>[ \t]*(?=\S)(?![=>\d-])", re.M)
_ATX = re.compile(r"^ {0,3}#{1,6}[ \t]+(?=\S)", re.M)
_SETEXT = re.compile(r"^(?=[^\n]*\w)(?![ \t]*(?:[-*+>|]|\d+[.)]|```)[^\n]*\n)[^\n|]+\n {0,3}(?:={2,}|-{2,})[ \t]*$", re.M)
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$", re.M)
_TABLE = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-{2,}:?[ \t]*\|[ \t]*$", re.M)

SUSPECT = r"[<>&\\$\[\]{}*_`=|~^#+]|''|(?:^|[\n\r])[ \t]*(?:-|\d{1,9}[.)][ \t])"


def set_code_aside(text: str) -> tuple[str, list[str]]:
    """The text with blanks for Markdown code, each piece by as many, and the pieces."""
    code: list[str] = []

    def blank(m: re.Match) -> str:
        code.append(m[0])
        return re.sub(r"[^\n]", " ", m[0])

    if "```" in text or "~~~" in text:
        text = _FENCED.sub(blank, text)
    if "`" in text:
        text = _SPAN.sub(blank, text)
    return text, code


class _Events(HTMLParser):
    """Whether the events of a text make it HTML, look-alikes left out. A text is fed in growing pieces until that is settled.

    A closing, void or self-closing tag of a known element is one wherever it stands, and so are comments and
    declarations. An opening tag directly behind a word may be a type parameter: it counts if it has attributes with
    values or if the element is closed later. A character reference must be one of the standard's, and one without its
    semicolon one of those that may go without.
    """

    PIECE = 4096  # characters of the first piece

    def __init__(self, text: str, fed: str | None = None):
        """``fed`` is the text with blanks for signs that open nothing, character by character."""
        super().__init__(convert_charrefs=False)
        self.text, self.fed, self.found = text, text if fed is None else fed, False
        self.starts = [0]

    def settle(self) -> bool:
        at, size = 0, self.PIECE
        while at < len(self.text):
            self.feed(self.fed[at : at + size])
            if self.found:
                return True
            # the parser rereads what it couldn't finish, so pieces grow with what was read
            at, size = at + size, 2 * size
        self.close()
        return self.found

    def _place(self) -> int:
        """Where the event starts, in characters of the whole text."""
        line, column = self.getpos()
        while len(self.starts) < line:
            self.starts.append(self.text.index("\n", self.starts[-1]) + 1)
        return self.starts[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in _NAMES:
            return
        shown = self.get_starttag_text() or ""
        if not _TAG.fullmatch(shown):
            return
        before = self.text[(at := self._place()) - 1 : at]
        self.found |= tag in VOID_NAMES or shown.endswith("/>") or "=" in shown or not (before.isalnum() or before in "_:.")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        # it counts if it was opened; alone it is residue all the same
        self.found |= tag in _NAMES and _TAG.match(self.text, self._place()) is not None

    def handle_comment(self, data: str) -> None:
        # an unclosed one, or one of another kind (``<?``, ``<!x``), is none
        self.found |= _COMMENT.match(self.text, self._place()) is not None

    handle_decl = unknown_decl = handle_pi = handle_comment

    def handle_charref(self, name: str) -> None:
        self.found |= _ENTITY.match(self.text, self._place()) is not None

    def handle_entityref(self, name: str) -> None:
        at = self._place()
        m = _ENTITY.match(self.text, at)
        self.found |= bool(m and m[1] + ";" in html5) or _LEGACY.match(self.text, at) is not None


# a sign that opens a tag which is never closed; the parser would look for its end anew at each of them
_LOOSE = re.compile(r"""<(?!!--)(?![/!?]?[a-zA-Z\[][^<>"']*+(?:"[^"]*+"[^<>"']*+|'[^']*+'[^<>"']*+)*+>)""")


def _is_html(text: str) -> bool:
    if "<" not in text and "&" not in text:
        return False
    last = text.rfind("-->")
    comments = text[: last + 1] + text[last + 1 :].replace("<!--", " !--") if "<!--" in text else text
    return _Events(text, _LOOSE.sub(" ", comments)).settle()


def _is_latex(text: str) -> bool:
    if "\\" in text and (_BRACED.search(text) or _BARE.search(text) or _BRACED_AFTER_WORD.search(text)):
        return True
    if "$" in text or "\\[" in text or "\\(" in text:
        if _DISPLAY.search(text):
            return True
        return any(_MATH.search(m[1]) for m in _DOLLARS.finditer(text))
    return False


def _is_wiki(text: str) -> bool:
    return bool(
        ("[[" in text and _WIKI_LINK.search(text))
        or ("//" in text and _WIKI_EXT.search(text))
        or ("{{" in text and _TEMPLATE.search(text))
        or ("''" in text and _QUOTES.search(text))
        or ("=" in text and any(len(m[1]) > 1 for m in _EQUALS.finditer(text)))
        or (("{|" in text or "|}" in text or "|-" in text) and _WIKI_TABLE.search(text) and ("{|" in text or "|}" in text))
        or ("__" in text and _MAGIC.search(text))
        or ("#R" in text and _MAGIC.search(text))
    )


def _is_markdown(text: str, code: list[str]) -> bool:
    if code:
        return True
    if "[" in text and (_LINK.search(text) or _IMAGE.search(text) or _REFERENCE.search(text) or _DEFINITION.search(text) or _FOOTNOTE.search(text)):
        return True
    if "<" in text and _AUTOLINK.search(text):
        return True
    if "*" in text and (_STRONG.search(text) or _INNER.search(text)):
        return True
    if "_" in text and any(" " in m[2] or len(m[1]) == 1 for m in _UNDER.finditer(text)):
        return True
    if "~~" in text and _STRIKE.search(text):
        return True
    return bool(_ITEM.search(text) or (">" in text and _QUOTE.search(text)) or ("#" in text and _ATX.search(text)) or _RULE.search(text) or (("==" in text or "--" in text) and _SETEXT.search(text)) or ("|" in text and _TABLE.search(text)))


def families(text: str | None) -> list[str]:
    """The kinds of markup a text holds, in the order of FAMILIES; none for a null or empty text."""
    if not text:
        return []
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    plain, code = set_code_aside(text)
    tests = (_is_html(plain), _is_latex(plain), _is_wiki(plain), _is_markdown(plain, code))
    return [name for name, yes in zip(FAMILIES, tests, strict=True) if yes]


class _Reader(HTMLParser):
    """Text of HTML by streaming events, with headings, lists and code in plain form."""

    _BREAKS = frozenset("address article aside blockquote dd div dl dt figure footer form header hr main nav ol p section table tr ul".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.lists: list[int] = []
        self.skip = 0
        self.cells = False  # whether the row has a cell yet

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in HTML_NAMES:
            if re.fullmatch("h[1-6]", tag):
                self.out.append("\n" + "#" * int(tag[1]) + " ")
            elif tag in ("ul", "ol"):
                self.lists.append(0 if tag == "ol" else -1)
                self.out.append("\n")
            elif tag == "li":
                if self.lists and self.lists[-1] >= 0:
                    self.lists[-1] += 1
                    self.out.append(f"\n{self.lists[-1]}. ")
                else:
                    self.out.append("\n- ")
            elif tag == "pre":
                self.out.append("\n```\n")
            elif tag in ("td", "th"):
                self.out.append("\t" if self.cells else "")
                self.cells = True
            elif tag == "br" or tag in self._BREAKS:
                self.out.append("\n")
                self.cells = self.cells and tag != "tr"
        else:  # no element: text that only looks like one
            self.out.append(self.get_starttag_text() or "")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in HTML_NAMES:
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            if tag == "pre":
                self.out.append("\n```\n")
            elif tag in self._BREAKS or re.fullmatch("h[1-6]", tag):
                self.out.append("\n")
        else:
            self.out.append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data)


def content_lines(text: str, sigma: float = 1.0) -> list[bool]:
    """Which lines of an HTML page are content: text-to-tag ratio per line, smoothed by a Gaussian, above one spread's threshold.

    The threshold is the standard deviation of the smoothed ratios, at most half their mean, so that an even page is
    content throughout.
    """
    return _regions(text.split("\n"), sigma)


def _regions(lines: list[str], sigma: float = 1.0) -> list[bool]:
    ratios = []
    for line in lines:
        tags = len(_TAG.findall(line)) + len(_COMMENT.findall(line))
        ratios.append(len(_TAG.sub("", _COMMENT.sub("", line)).strip()) / max(1, tags))
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    smooth = []
    for i in range(len(ratios)):
        part = [(ratios[i + k], kernel[k + reach]) for k in range(-reach, reach + 1) if 0 <= i + k < len(ratios)]
        smooth.append(sum(r * w for r, w in part) / sum(w for _, w in part))
    mean = sum(smooth) / len(smooth)
    spread = math.sqrt(sum((s - mean) ** 2 for s in smooth) / len(smooth))
    threshold = min(spread, mean / 2)
    return [s >= threshold for s in smooth]


_BLOCKS = "(?:" + "|".join(sorted([*_Reader._BREAKS, "li", "h[1-6]", "pre", "nav", "aside", "body", "head", "html", "title"], key=len, reverse=True)) + ")"
_CUT = re.compile(rf"\n|</{_BLOCKS}\s*>(?:[ \t]*\n)?|(?=<{_BLOCKS}[\s>/])", re.I)
_STAYS = re.compile(r"<h[1-6][\s>]|<(?:code|kbd|samp|math|pre)[\s>]|^[ \t]*#{1,6}[ \t]|^[ \t]*={2,6}[^=]", re.I)
_DEPTHS = {"ul": "list", "ol": "list", "dl": "list", "table": "list", "pre": "code", "nav": "nav", "footer": "nav"}
_BOXES = frozenset("address article aside blockquote body center div fieldset figure footer form header html main nav section".split())
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*\s*$")
_LISTED = re.compile(r"<(?:li|dt|dd|tr|td|th|caption)[\s>]", re.I)


def pieces(text: str) -> list[str]:
    """The text cut behind line ends and closing block tags, and before opening ones; joined it is the text again."""
    cuts = sorted({0, len(text), *(m.end() for m in _CUT.finditer(text))})
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _without_furniture(text: str, mark: str = "\ue000") -> str:
    """An HTML text without the words of short lines outside of the content regions; their tags stay, since lists need them.

    HTML is a text of whose pieces at least half hold a tag. Left in any case are headings, code, formulas, sentences,
    text that no element encloses, and list items and table rows that don't stand in a ``nav`` or ``footer``.
    ``mark`` begins the places of code and formulas that were set aside.
    """
    each = pieces(text)
    full = [x for x in each if x.strip()]
    if sum(bool(_TAG.search(x)) for x in full) * 2 < len(full):
        return text
    depth = dict.fromkeys(("list", "code", "nav", "box"), 0)
    out = []
    for x, good in zip(each, _regions(each), strict=True):
        inside = dict(depth)
        for m in _TAG.finditer(x):
            name = m[2].lower()
            for kind in filter(None, (_DEPTHS.get(name), "box" if name in _BOXES else None)):
                depth[kind] = max(0, depth[kind] + (-1 if m[1] else 1))
                inside[kind] = max(inside[kind], depth[kind])
        shown = _TAG.sub("", x)
        loose = shown == x and not inside["box"]
        stays = loose or _STAYS.search(x) or mark in x or _SENTENCE.search(shown) or inside["code"] or ((inside["list"] or _LISTED.search(x) or _ITEM.match(x)) and not inside["nav"])
        if good or stays or len(shown.split()) > 4:
            out.append(x)
        else:
            out.append("".join(m[0] for m in _TAG.finditer(x)) + "\n" * x.endswith("\n"))
    return "".join(out)


def _marks(text: str) -> tuple[str, str]:
    """Two characters of private use that the text doesn't hold."""
    if "\ue000" not in text and "\ue001" not in text:
        return "\ue000", "\ue001"
    own = set(text)
    free = (c for c in map(chr, chain(range(0xE000, 0xF900), range(0xF0000, 0xFFFFE), range(0x100000, 0x10FFFE))) if c not in own)
    return next(free), next(free)


def clean(text: str | None) -> str | None:
    """The text without markup, with headings (``#``), lists (``-``, ``1.``), code blocks and formulas in plain form.

    A text without markup comes back as it is, a null one as null.
    """
    found = families(text)
    if not found:
        return text
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    kept: list[str] = []
    first, last = _marks(text)

    def keep(piece: str) -> str:
        kept.append(piece)
        return f"{first}{len(kept) - 1}{last}"

    def put_back(text: str) -> str:
        # what was set aside later may hold places of what was set aside before
        return re.sub(f"{first}(\\d+){last}", lambda m: put_back(kept[int(m[1])]), text)

    text = _FENCED.sub(lambda m: keep(m[0]), text)
    text = _SPAN.sub(lambda m: keep(m[2].strip() or m[2]), text)
    if "latex" in found:
        text = re.sub(r"\\begin\{(equation|align|gather|displaymath|math|eqnarray)(\*?)\}(.*?)\\end\{\1\2\}", lambda m: keep("$$" + re.sub(r"\\label\{[^{}]*\}", "", m[3]).strip() + "$$"), text, flags=re.S)
        text = re.sub(r"\\begin\{(verbatim|lstlisting)\}(.*?)\\end\{\1\}", lambda m: keep("```\n" + m[2].strip("\n") + "\n```"), text, flags=re.S)
        text = _DISPLAY.sub(lambda m: keep(m[0]), text)
        text = _DOLLARS.sub(lambda m: keep(m[0]) if _MATH.search(m[1]) else m[0], text)
        text = re.sub(r"\\(sub)*section\*?\{([^{}]*)\}", lambda m: "#" * (1 + m[0].count("sub")) + " " + m[2], text)
        text = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\[\]]*\])?", "", text)
        text = re.sub(r"(?m)^[ \t]*\\item\b[ \t]*", "- ", text)
        text = re.sub(r"~?\\(?:cite[a-z]*|ref|eqref|label|pageref)\*?(?:\[[^\[\]]*\])?\{[^{}]*\}", "", text)
        text = re.sub(r"(?<![\w:\\/])\\[a-zA-Z]+\*?(?:\[[^\[\]\n]*\])?\{([^{}]*)\}", r"\1", text)
        text = _BARE.sub("", text)
    if "html" in found:
        text = _without_furniture(text, first)
        reader = _Reader()
        # what only looks like a tag must not reach the parser
        safe = re.sub(r"<(?!/?" + _NAME + r"(?=[\s>/])|!--|!DOCTYPE)", "&lt;", text, flags=re.I)
        reader.feed(re.sub(r"&(?!#\d|#[xX]|[A-Za-z][A-Za-z0-9]*;|" + _LEGACY.pattern[1:] + ")", "&amp;", safe))
        reader.close()
        text = "".join(reader.out)
        if _TAG.search(text):  # tags that were written as character references
            text = _TAG.sub("", text)
    if "wiki" in found:
        text = re.sub(r"\[\[(?:Category|File|Image|Kategorie|Datei):[^\[\]\n]*\]\]", "", text)
        text = _WIKI_LINK.sub(lambda m: m[0][2:-2].rpartition("|")[2], text)
        text = _WIKI_EXT.sub(lambda m: m[0][1:-1].partition(" ")[2].strip() or m[0][1:-1], text)
        text = _MAGIC.sub("", _TEMPLATE.sub("", text))
        text = _QUOTES.sub(r"\2", text)
        text = _EQUALS.sub(lambda m: "#" * len(m[1]) + " " + m[2] if len(m[1]) > 1 else m[0], text)
        if "{|" in text or "|}" in text:
            text = re.sub(r"(?m)^[ \t]*(?:\{\|[^\n]*|\|\}|\|-[^\n]*|\|\+)[ \t]*$", "", text)
            text = re.sub(r"(?m)^[ \t]*[|!][ \t]*", "", text).replace("||", "\t").replace("!!", "\t")
    if "markdown" in found:
        text = _IMAGE.sub(lambda m: m[0][2 : m[0].index("]")], text)
        text = _LINK.sub(r"\1", text)
        text = _REFERENCE.sub(lambda m: m[0][1 : m[0].index("]")], text)
        text = re.sub(r"(?m)^ {0,3}\[\^[^\[\]\s]+\]:[ \t]*", "", text)
        text = _DEFINITION.sub("", text)
        text = _FOOTNOTE.sub("", text)
        text = _AUTOLINK.sub(lambda m: m[0][1:-1], text)
        text = _STRONG.sub(r"\2", _INNER.sub(lambda m: m[2] or m[4], text))
        text = _UNDER.sub(lambda m: m[2] if " " in m[2] or len(m[1]) == 1 else m[0], text)
        text = _STRIKE.sub(r"\1", text)
        text = re.sub(r"(?m)^ {0,3}>[ \t]?", "", text)
        text = _RULE.sub("", text)
        text = _TABLE.sub("", text)
        text = re.sub(r"(?m)^[ \t]*\|(.*)\|[ \t]*$", lambda m: "\t".join(x.strip() for x in m[1].split("|")), text)
        text = re.sub(r"(?m)^([ \t]*)[*+]([ \t]+)", r"\1-\2", text)
        text = re.sub(r"(?m)^([^\n#>|-][^\n]*)\n {0,3}(=+|-{2,})[ \t]*$", lambda m: ("# " if m[2][0] == "=" else "## ") + m[1].strip(), text)
    text = re.sub(r"\n{3,}", "\n\n", text)
    return put_back(text).strip("\n")


def _residue(with_text: bool):
    """Rows ``(id, mtime, tie, body, hierarchy)`` to the families of both fields, and the clean texts where asked for."""
    kinds = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for b in batches:
            bodies, titles = b.column(3).to_pylist(), b.column(4).to_pylist()

            def of_titles(entries: list[str | None] | None) -> list[str]:
                found: set[str] = set()
                for e in entries or ():
                    if e not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known[e] = families(e)
                    found.update(known[e])
                return [f for f in FAMILIES if f in found]

            cols = [b.column(0), b.column(1), b.column(2), pa.array([families(x) for x in bodies], kinds), pa.array([of_titles(x) for x in titles], kinds)]
            names = ["id", "mtime", "tie", "body_families", "hierarchy_families"]
            if with_text:
                cols += [pa.array([clean(x) for x in bodies], pa.string()), pa.array([None if x is None else [clean(e) for e in x] for x in titles], pa.list_(pa.string()))]
                names += ["clean_body", "clean_hierarchy"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def read(chunks: DataFrame, with_text: bool = False) -> DataFrame:
    """Of every current row ``(id, body_families, hierarchy_families)``, and ``clean_body, clean_hierarchy`` where asked for.

    Texts are read before the current rows are found, so that only what was read of them crosses the network, and
    only rows with a character that markup needs go through Python.
    """
    odd = F.col("body").rlike(SUSPECT) | F.exists(F.coalesce("hierarchy", F.array().cast("array<string>")), lambda t: F.coalesce(t.rlike(SUSPECT), F.lit(False)))
    rows = chunks.where("id is not null").select("id", "mtime", F.xxhash64("body", "tags", "hierarchy").alias("tie"), "body", "hierarchy", F.coalesce(odd, F.lit(False)).alias("odd"))
    cast = rows.withColumn("mtime", F.col("mtime").cast("timestamp_ntz"))
    kinds = ("body_families", "hierarchy_families")
    texts = ("clean_body", "clean_hierarchy") if with_text else ()
    schema = "id string, mtime timestamp_ntz, tie long, body_families array<string>, hierarchy_families array<string>" + (", clean_body string, clean_hierarchy array<string>" if with_text else "")
    done = cast.where("odd").select("id", "mtime", "tie", "body", "hierarchy").mapInArrow(_residue(with_text), schema)
    none = F.array().cast("array<string>")
    same = [F.col("body").alias("clean_body"), F.col("hierarchy").alias("clean_hierarchy")] if with_text else []
    rest = cast.where("not odd").select("id", "mtime", "tie", *[none.alias(k) for k in kinds], *same)
    return newest_rows(done.unionByName(rest), *kinds, *texts, tie=("tie",))

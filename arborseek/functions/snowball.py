"""Stemming of words of other languages than English by the published Snowball rules."""

from __future__ import annotations

import re


def _after(w: str, vowels: str, start: int = 0) -> int:
    """Behind the first consonant that follows a vowel, from ``start`` on."""
    m = re.compile(f"[{vowels}][^{vowels}]").search(w, start)
    return m.end() if m else len(w)


def _longest(w: str, ends: str | list[str], start: int = 0) -> str | None:
    """The longest of the endings that lies behind ``start``."""
    fit = [e for e in (ends.split() if isinstance(ends, str) else ends) if w.endswith(e) and len(w) - len(e) >= start]
    return max(fit, key=len) if fit else None


def _marked(w: str, pattern: str) -> str:
    return re.sub(pattern, lambda m: m[0].upper(), w)


# --- German ---------------------------------------------------------------------------------------------------------

_DE = "aeiouyäöü"


def german(word: str) -> str:
    w = _marked(word.replace("ß", "ss"), f"(?<=[{_DE}])[uy](?=[{_DE}])")
    first = _after(w, _DE)
    r1, r2 = max(3, first), _after(w, _DE, first)
    end = _longest(w, "em ern er e en es s")
    if end and len(w) - len(end) >= r1 and (end != "s" or re.search("[bdfghklmnrt]s$", w)):
        w = w[: -len(end)]
        if end in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    end = _longest(w, "en er est st")
    if end and len(w) - len(end) >= r1 and (end != "st" or re.search("...[bdfghklmnt]st$", w)):
        w = w[: -len(end)]
    end = _longest(w, "end ung ig ik isch lich heit keit", r2)
    if end in ("end", "ung"):
        w = w[: -len(end)]
        if re.search("(?<!e)ig$", w) and len(w) - 2 >= r2:
            w = w[:-2]
    elif end in ("ig", "ik", "isch"):
        w = w if w[: -len(end)].endswith("e") else w[: -len(end)]
    elif end in ("lich", "heit"):
        w = w[: -len(end)]
        w = w[:-2] if w.endswith(("er", "en")) and len(w) - 2 >= r1 else w
    elif end == "keit":
        w = w[:-4]
        inner = _longest(w, "lich ig", r2)
        w = w[: -len(inner)] if inner else w
    return w.lower().translate(str.maketrans("äöü", "aou"))


# --- Spanish --------------------------------------------------------------------------------------------------------

_ES = "aeiouáéíóúü"
_PLAIN = str.maketrans("áéíóú", "aeiou")
# fixed values: the endings of the published algorithm
_ES_PRONOUNS = "me se sela selo selas selos la le lo las les los nos"
_ES_ALONE = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos"
_ES_IC = "adora ador ación adoras adores aciones ante antes ancia ancias"
_ES_NEW = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
_ES_INNER = {"mente": "ante able ible", "idad": "abil ic iv", "idades": "abil ic iv", "iva": "at", "ivo": "at", "ivas": "at", "ivos": "at"}
_ES_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos"
_ES_VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré "
    "irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran "
    "ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais "
    "ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
)


def _spanish_rv(w: str) -> int:
    if len(w) < 3:
        return len(w)
    if w[1] not in _ES:
        m = re.compile(f"[{_ES}]").search(w, 2)
    elif w[0] in _ES:
        m = re.compile(f"[^{_ES}]").search(w, 2)
    else:
        return 3
    return m.end() if m else len(w)


def spanish(word: str) -> str:
    w = word
    rv, r1 = _spanish_rv(w), _after(w, _ES)
    r2 = _after(w, _ES, r1)
    end = _longest(w, _ES_PRONOUNS, rv)
    if end:
        base = w[: -len(end)]
        if _longest(base, "iéndo ándo ár ér ír", rv):
            w = base.translate(_PLAIN) if not base.endswith("yendo") else base
        elif _longest(base, "ando iendo ar er ir", rv) or (_longest(base, "yendo", rv) and base.endswith("uyendo")):
            w = base
    known = [*_ES_ALONE.split(), *_ES_IC.split(), *_ES_NEW, "amente", *_ES_INNER]
    end, start = _longest(w, known), w
    at = len(w) - len(end) if end else 0

    def drop(ends: str) -> None:
        nonlocal w
        inner = _longest(w, ends)
        w = w[: -len(inner)] if inner and len(w) - len(inner) >= r2 else w

    if end == "amente":
        if at >= r1:
            w = w[:at]
            if w.endswith("iv"):
                if at - 2 >= r2:
                    w = w[:-2]
                    drop("at")
            else:
                drop("os ic ad")
    elif end and at >= r2:
        w = w[:at] + _ES_NEW.get(end, "")
        if end in _ES_IC.split():
            drop("ic")
        elif end in _ES_INNER:
            drop(_ES_INNER[end])
    if w == start:
        end = _longest(w, _ES_Y, rv)
        if end and w[: -len(end)].endswith("u"):
            w = w[: -len(end)]
        else:
            end = _longest(w, "en es éis emos " + _ES_VERBS, rv)
            if end:
                w = w[: -len(end)]
                w = w[:-1] if end in ("en", "es", "éis", "emos") and w.endswith("gu") else w
    end = _longest(w, "os a o á í ó e é", rv)
    if end:
        w = w[: -len(end)]
        w = w[:-1] if end in "eé" and w.endswith("gu") and len(w) - 1 >= rv else w
    return w.translate(_PLAIN)


# --- French ---------------------------------------------------------------------------------------------------------

_FR = "aeiouyâàëéêèïîôûù"
# fixed values: the endings of the published algorithm
_FR_ALONE = "ance iqUe isme able iste eux ances iqUes ismes ables istes"
_FR_ATION = "atrice ateur ation atrices ateurs ations"
_FR_NEW = {"logie": "log", "logies": "log", "usion": "u", "ution": "u", "usions": "u", "utions": "u", "ence": "ent", "ences": "ent"}
_FR_REST = "ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments"
_FR_I = (
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant "
    "issante issantes issants isse issent isses issez issiez issions issons it"
)
_FR_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez"
_FR_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions"


def _french_rv(w: str) -> int:
    if w.startswith(("par", "col", "tap")) or re.match(f"[{_FR}][{_FR}]", w):
        return min(3, len(w))
    m = re.compile(f"[{_FR}]").search(w, 1)
    return m.end() if m else len(w)


class _French:
    def __init__(self, word: str):
        w = _marked(word, f"(?<=[{_FR}])[ui](?=[{_FR}])|(?<=[{_FR}])y|y(?=[{_FR}])|(?<=q)u")
        self.w, self.rv, self.r1 = w, _french_rv(w), _after(w, _FR)
        self.r2 = _after(w, _FR, self.r1)

    def ends(self, end: str, start: int) -> bool:
        return self.w.endswith(end) and len(self.w) - len(end) >= start

    def swap(self, end: str, new: str = "") -> None:
        self.w = self.w[: len(self.w) - len(end)] + new

    def either(self, end: str, new: str) -> bool:
        """Delete an ending in R2, elsewhere replace it; False if it isn't there."""
        if not self.w.endswith(end):
            return False
        self.swap(end, "" if self.ends(end, self.r2) else new)
        return True

    def standard(self) -> bool:
        """Whether verb endings are looked for next: nothing was changed, or an adverb was."""
        end = _longest(self.w, [*_FR_ALONE.split(), *_FR_ATION.split(), *_FR_NEW, *_FR_REST.split()])
        before = self.w
        if end is None:
            return True
        if end in _FR_ALONE.split() and self.ends(end, self.r2):
            self.swap(end)
        elif end in _FR_ATION.split() and self.ends(end, self.r2):
            self.swap(end)
            self.either("ic", "iqU")
        elif end in _FR_NEW and self.ends(end, self.r2):
            self.swap(end, _FR_NEW[end])
        elif end in ("ement", "ements") and self.ends(end, self.rv):
            self.swap(end)
            if self.w.endswith("iv"):
                if self.ends("iv", self.r2):
                    self.swap("iv")
                    if self.ends("at", self.r2):
                        self.swap("at")
            elif self.w.endswith("eus"):
                if self.ends("eus", self.r2):
                    self.swap("eus")
                elif self.ends("eus", self.r1):
                    self.swap("eus", "eux")
            elif self.w.endswith(("abl", "iqU")):
                if self.ends(self.w[-3:], self.r2):
                    self.swap("abl")
            elif self.ends("ièr", self.rv) or self.ends("Ièr", self.rv):
                self.swap("ièr", "i")
        elif end in ("ité", "ités") and self.ends(end, self.r2):
            self.swap(end)
            if not (self.either("abil", "abl") or self.either("ic", "iqU")) and self.ends("iv", self.r2):
                self.swap("iv")
        elif end in ("if", "ive", "ifs", "ives") and self.ends(end, self.r2):
            self.swap(end)
            if self.ends("at", self.r2):
                self.swap("at")
                self.either("ic", "iqU")
        elif end == "eaux":
            self.swap("x")
        elif end == "aux" and self.ends(end, self.r1):
            self.swap(end, "al")
        elif end in ("euse", "euses"):
            if self.ends(end, self.r2):
                self.swap(end)
            elif self.ends(end, self.r1):
                self.swap(end, "eux")
        elif end in ("issement", "issements") and self.ends(end, self.r1) and re.search(f"[^{_FR}]{end}$", self.w):
            self.swap(end)
        elif end in ("amment", "emment") and self.ends(end, self.rv):
            self.swap(end, end[0] + "nt")
            return True
        elif end in ("ment", "ments") and re.search(f"[{_FR}]{end}$", self.w[self.rv :]):
            self.swap(end)
            return True
        return self.w == before

    def verb(self) -> None:
        end = _longest(self.w, _FR_I, self.rv)
        if end and re.search(f"[^{_FR}]{end}$", self.w[self.rv :]):
            self.swap(end)
            return
        end = _longest(self.w, f"ions {_FR_E} {_FR_A}", self.rv)
        if end == "ions":
            if self.ends(end, self.r2):
                self.swap(end)
        elif end:
            self.swap(end)
            if end in _FR_A.split() and self.ends("e", self.rv):
                self.swap("e")

    def rest(self) -> None:
        self.w = re.sub("(?<=[^aiouès])s$", "", self.w)
        end = _longest(self.w, "ion ier ière Ier Ière e", self.rv)
        if end == "ion":
            if self.ends(end, self.r2) and re.search("[st]ion$", self.w[self.rv :]):
                self.swap(end)
        elif end:
            self.swap(end, "" if end == "e" else "i")

    def stem(self) -> str:
        before = self.w
        if self.standard():
            self.verb()
        if self.w != before:
            self.w = re.sub("Y$", "i", re.sub("ç$", "c", self.w))
        else:
            self.rest()
        if self.w.endswith(("enn", "onn", "ett", "ell", "eill")):
            self.w = self.w[:-1]
        return re.sub(f"[éè]([^{_FR}]+)$", r"e\1", self.w).lower()


def french(word: str) -> str:
    return _French(word).stem()


# --- Danish, Norwegian, Swedish -------------------------------------------------------------------------------------

# fixed values: the endings of the published algorithms
_DA = "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret"
_NO = "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast"
_SV = (
    "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens "
    "erns at andet het ast"
)


def danish(word: str) -> str:
    vowels = "aeiouyæåø"
    r1 = max(3, _after(word, vowels))

    def shorter(w: str) -> str:
        return w[:-1] if _longest(w, "gd dt gt kt", r1) else w

    end, w = _longest(word, f"{_DA} s", r1), word
    if end and (end != "s" or re.search("[abcdfghjklmnoprtvyzå]s$", w)):
        w = w[: -len(end)]
    w = shorter(w)
    w = w[:-2] if w.endswith("igst") else w
    end = _longest(w, "ig lig elig els løst", r1)
    if end:
        w = w[:-1] if end == "løst" else shorter(w[: -len(end)])
    return w[:-1] if len(w) - 2 >= r1 and w[-1] == w[-2] and w[-1] not in vowels else w


def norwegian(word: str) -> str:
    vowels = "aeiouyæåø"
    r1 = max(3, _after(word, vowels))
    end, w = _longest(word, f"{_NO} s erte ert", r1), word
    if end in ("erte", "ert"):
        w = w[: -len(end)] + "er"
    elif end and (end != "s" or re.search(f"(?:[bcdfghjlmnoprtvyz]|[^{vowels}]k)s$", w)):
        w = w[: -len(end)]
    w = w[:-1] if _longest(w, "dt vt", r1) else w
    end = _longest(w, "leg eleg ig eig lig elig els lov elov slov hetslov", r1)
    return w[: -len(end)] if end else w


def swedish(word: str) -> str:
    r1 = max(3, _after(word, "aeiouyåäö"))
    end, w = _longest(word, f"{_SV} s", r1), word
    if end and (end != "s" or re.search("[bcdfghjklmnoprtvy]s$", w)):
        w = w[: -len(end)]
    w = w[:-1] if _longest(w, "dd gd nn dt gt kt tt", r1) else w
    end = _longest(w, "lig ig els löst fullt", r1)
    return w if not end else w[:-1] if end in ("löst", "fullt") else w[: -len(end)]

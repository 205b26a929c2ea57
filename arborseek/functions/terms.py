"""Words of context analysis: paths, plain words without stemming, stopwords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_LENGTH = 4
# fixed values: frequent English words that name nothing; longer lists come in by the parameter ``stop``
STOPWORDS = (
    "a about above after again against all also am an and any are as at be because been before being below between both but by "
    "can could did do does doing down during each few for from further had has have having he her here hers him his how i if in "
    "into is it its just me more most my no nor not now of off on once only or other our ours out over own same she should so some "
    "such than that the their theirs them then there these they this those through to too under until up very was we were what when "
    "where which while who whom why will with would you your yours "
    "across almost along already although always among another anyone anything around away back became become becomes behind beside "
    "besides beyond came cannot come could done either enough even ever every everyone everything gave get gets give given gives go "
    "goes gone got however indeed instead keep kept know known last least less like made make makes many may maybe might mine much "
    "must myself need needs neither never next nobody none nothing often ourselves perhaps please put quite rather really said say says "
    "see seem seems seen several shall since something sometimes somewhere soon still take taken thing things think though thus together "
    "took toward towards unless upon used uses using usually want wants well went whatever whenever whether whose within without "
    "yes yet yourself"
).split()
# fixed values: keywords and reserved words of a programming language, its primitive types, and names of its prelude
CODE_STOPWORDS = (
    "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self static struct "
    "super trait true type unsafe use where while async await dyn abstract become box do final macro override priv typeof unsized virtual "
    "yield try gen macro_rules raw safe union bool char str i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64 array slice tuple "
    "unit pointer reference never option some none result ok err clone copy default drop eq partialeq ord partialord hash debug display "
    "from into tryfrom tryinto asref asmut deref derefmut iterator intoiterator extend send sync sized unpin fn fnmut fnonce toowned "
    "tostring vec string box rc arc cell refcell mutex rwlock println print eprintln eprint format vec panic assert assert_eq assert_ne "
    "debug_assert debug_assert_eq debug_assert_ne todo unimplemented unreachable"
).split()
# fixed values: parts of paths that tell nothing about a file
PATH_EXTENSIONS = "rs py js ts go md txt html css json".split()
PATH_FOLDERS = "src lib bin test tests docs doc".split()
STOP = sorted(set(STOPWORDS) | set(CODE_STOPWORDS))
_PUNCTUATION = r"[\s!-/:-@\[-`{-~]+"


def context_words(text: Column | str, shortest: int = MIN_LENGTH, stop: list[str] = STOP) -> Column:
    """Words between blanks and ASCII punctuation, lower-cased, of at least so many bytes, all letters and digits, no stopwords."""
    col = F.col(text) if isinstance(text, str) else text
    found = F.split(F.lower(col), _PUNCTUATION)
    kept = F.filter(found, lambda w: (F.octet_length(w) >= shortest) & w.rlike(r"^[\p{L}\p{N}]+$") & ~w.isin(stop))
    return F.coalesce(kept, F.array().cast("array<string>"))


def path_words(path: Column | str, shortest: int = MIN_LENGTH, stop: list[str] = STOP) -> Column:
    """``array<struct<term, weight>>`` of a path: parts between ``/ _ - .``; those of the file name weigh 4, of folders 3."""
    col = F.col(path) if isinstance(path, str) else path
    split = lambda c: F.filter(F.split(F.lower(c), r"[/\\_\-.]+"), lambda w: (F.octet_length(w) >= shortest) & w.rlike(r"^[\p{L}\p{N}]+$") & ~w.isin(stop))
    name, folder = F.regexp_extract(col, r"([^/]*)$", 1), F.regexp_extract(col, r"^(.*/)[^/]*$", 1)
    weigh = lambda words, weight: F.transform(words, lambda w: F.struct(w.alias("term"), F.lit(weight).alias("weight")))
    return F.concat(weigh(split(name), 4.0), weigh(split(folder), 3.0))


def telling_path_words(path: Column | str, shortest: int = 3) -> Column:
    """The parts of a path between ``/ _ - .`` that may tell what the file is about, each once, in order.

    Left out are those below ``shortest`` bytes, common file extensions, and folders every project has. A null path gives null.
    """
    col = F.col(path) if isinstance(path, str) else path
    found = F.split(F.lower(col), r"[/\\_\-.]+")
    return F.array_distinct(F.filter(found, lambda w: (F.octet_length(w) >= shortest) & ~w.isin(PATH_EXTENSIONS + PATH_FOLDERS)))

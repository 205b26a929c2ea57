"""Column functions of text analysis: terms, slugs, ids, titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
LONGEST = 40  # terms of so many UTF-8 bytes or more are left out of the index


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """All maximal runs of letters and digits of the lower-cased text, in order; null gives null."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD), F.lit(0))


def terms(text: Column | str) -> Column:
    """Index terms: :func:`words` without those of :data:`LONGEST` UTF-8 bytes or more; null gives no terms."""
    # the length test over each word runs only where a run of letters and digits is long enough to fail it
    found, long = words(text), F.lower(_col(text)).rlike(r"[\p{L}\p{N}]{10}")
    kept = F.filter(found, lambda w: F.octet_length(w) < LONGEST)
    return F.coalesce(F.when(long, kept).otherwise(found), F.array().cast("array<string>"))


def slug(title: Column | str) -> Column:
    """Base slug of a heading: ASCII letters, digits and ``_`` lower-cased, blanks and ``-`` as one ``-``; else ``heading``."""
    kept = F.regexp_replace(_col(title), r"[^A-Za-z0-9_ \-]", "")
    dashed = F.regexp_replace(F.lower(kept), r"[ \-]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, r"^-|-$", ""), F.lit("")), F.lit("heading"))


def parse_id(text: str) -> tuple[str, str, str | None] | None:
    """``(tree, path, slug)`` of a chunk's id; None for what is none, as a path of a file with a drive letter."""
    tree, colon, rest = text.partition(":")
    if not (tree and colon and rest) or (len(tree) == 1 and rest[0] in "\\/"):
        return None
    path, mark, name = rest.partition("#")
    return tree, path, name if mark else None


def breadcrumb(hierarchy: Column | str) -> Column:
    return F.array_join(_col(hierarchy), " > ")


def title(hierarchy: Column | str) -> Column:
    """The last element, null for an empty or null hierarchy."""
    return F.try_element_at(_col(hierarchy), F.lit(-1))

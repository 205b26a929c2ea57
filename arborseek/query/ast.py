"""Query expressions. ``And`` and ``Or`` are made by :func:`all_of` and :func:`any_of`, which flatten."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]


@dataclass(frozen=True)
class Not:
    child: Expr


@dataclass(frozen=True)
class And:
    children: tuple[Expr, ...]


@dataclass(frozen=True)
class Or:
    children: tuple[Expr, ...]


@dataclass(frozen=True)
class Field:
    name: str
    child: Expr


@dataclass(frozen=True)
class Boost:
    child: Expr
    factor: float


Expr = Term | Phrase | Not | And | Or | Field | Boost


def _joined(kind: type, parts: list[Expr]) -> Expr:
    flat: list[Expr] = []
    for p in parts:
        flat += p.children if isinstance(p, kind) else [p]
    return flat[0] if len(flat) == 1 else kind(tuple(flat))


def all_of(*parts: Expr) -> Expr:
    return _joined(And, list(parts))


def any_of(*parts: Expr) -> Expr:
    return _joined(Or, list(parts))


def leaf_terms(e: Expr) -> list[str]:
    """All words of the leaves in order, those of negated ones too."""
    match e:
        case Term(text):
            return [text]
        case Phrase(words):
            return list(words)
        case And(children) | Or(children):
            return [t for c in children for t in leaf_terms(c)]
        case Not(child) | Field(_, child) | Boost(child, _):
            return leaf_terms(child)


def to_query(e: Expr) -> str:
    """A query string that parses to the same expression."""
    match e:
        case Term(text):
            return text if text else '""'
        case Phrase(words):
            return '"' + " ".join(words) + '"'
        case Not(child):
            return "-" + (f"({to_query(child)})" if isinstance(child, And | Or) else to_query(child))
        case And(children):
            return " ".join(f"({to_query(c)})" if isinstance(c, Or) else to_query(c) for c in children)
        case Or(children):
            return " OR ".join(to_query(c) for c in children)
        case Field(name, child):
            return f"{name}:" + (to_query(child) if isinstance(child, Term | Phrase) else f"({to_query(child)})")
        case Boost(child, factor):
            return (f"({to_query(child)})" if isinstance(child, And | Or | Not) else to_query(child)) + f"^{factor:g}"


def tree_lines(e: Expr, depth: int = 0) -> list[str]:
    """The expression as an indented tree, for explanations."""
    pad = "  " * depth
    match e:
        case Term(text):
            return [f"{pad}Term({text!r})"]
        case Phrase(words):
            return [f"{pad}Phrase({' '.join(words)!r})"]
        case And(children) | Or(children):
            return [f"{pad}{type(e).__name__}", *(x for c in children for x in tree_lines(c, depth + 1))]
        case Not(child):
            return [f"{pad}Not", *tree_lines(child, depth + 1)]
        case Field(name, child):
            return [f"{pad}Field({name})", *tree_lines(child, depth + 1)]
        case Boost(child, factor):
            return [f"{pad}Boost({factor:g})", *tree_lines(child, depth + 1)]

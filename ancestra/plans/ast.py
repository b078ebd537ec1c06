"""Query trees and query options."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Union

MUST, SHOULD, MUST_NOT = "+", "", "-"


@dataclass(frozen=True)
class Term:
    field: str
    text: str
    boost: float = 1.0


@dataclass(frozen=True)
class Phrase:
    field: str
    words: tuple[str, ...]
    boost: float = 1.0


@dataclass(frozen=True)
class Prefix:
    """scored: found by position in the rewrites of places; others score their boost alone. Both compile alike."""

    field: str
    text: str
    boost: float = 1.0
    scored: bool = False


@dataclass(frozen=True)
class Wildcard:
    field: str
    text: str
    boost: float = 1.0


@dataclass(frozen=True)
class Range:
    field: str
    low: str
    high: str
    boost: float = 1.0


@dataclass(frozen=True)
class Fuzzy:
    field: str
    text: str
    least: float = 0.65
    boost: float = 1.0


@dataclass(frozen=True)
class Popularity:
    """Popularity over 1024, matching every document."""

    boost: float = 1.0


@dataclass(frozen=True)
class DisMax:
    """Any of the queries; the score is the largest."""

    queries: tuple[Query, ...]
    boost: float = 1.0


@dataclass(frozen=True)
class Bool:
    clauses: tuple[tuple[str, Query], ...] = ()
    boost: float = 1.0


Query = Union[Term, Phrase, Prefix, Wildcard, Range, Fuzzy, Popularity, DisMax, Bool]  # noqa: UP007


def boosted(q: Query, boost: float) -> Query:
    return replace(q, boost=boost)


@dataclass
class Options:
    """What a search asks besides its query, and what its rewrites look up and leave."""

    filters: tuple[tuple[str, str], ...] = ()
    sort: str | None = None
    default_operator: str | None = None
    default_field: str = "Keywords"
    exact: bool = False
    sub: bool = False
    sup: bool = False
    #: text -> titles of matching places; title -> further places it is located in; (name, is surname) -> related names.
    match_places: Callable[[str], list[str]] = lambda text: []
    also_located_in: Callable[[str], list[str]] = lambda title: []
    related_names: Callable[[str, bool], list[str]] = lambda name, surname: []
    place_matches: dict[str, list[str]] = field(default_factory=dict)

    def within(self, *namespaces: str) -> bool:
        """Whether a filter is a bare term on one of the namespaces."""
        return any(f == "Namespace" and v in namespaces for f, v in self.filters)


def show(q: Query) -> str:
    """One line for a tree, for snapshots and logs."""
    tail = "" if q.boost == 1.0 else f"^{q.boost:g}"
    match q:
        case Term(f, t):
            body = f"{f}:{t}" if t and not set(t) & set(' ,()"') else f'{f}:"{t}"'
        case Phrase(f, w):
            body = f'{f}:"{" ".join(w)}"'
        case Prefix(f, t):
            body = f"{f}:{t}*"
        case Wildcard(f, t):
            body = f"{f}:{t}"
        case Range(f, a, b):
            body = f"{f}:[{a} TO {b}]"
        case Fuzzy(f, t, s):
            body = f"{f}:{t}~{s:g}"
        case Popularity():
            body = "popularity"
        case DisMax(qs):
            body = "(" + " | ".join(map(show, qs)) + ")"
        case Bool(cs):
            body = "(" + " ".join(o + show(x) for o, x in cs) + ")"
    return body + tail

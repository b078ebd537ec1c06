"""Analyzers: from a field's values to the array of terms that is indexed, by name and by field.

Chains are declared here: the order of their steps decides the terms.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ancestra import data

from . import dates, names, place, text

Analyzer = Callable[[Column], Column]
MOST_TERM = 1024

_REGISTRY: dict[str, Callable[..., Analyzer]] = {}


def analyzer(name: str):
    def put(f):
        _REGISTRY[name] = f
        return f

    return put


def make(name: str, **options) -> Analyzer:
    """An analyzer by its name: a function from a string Column to an array of terms."""
    return _REGISTRY[name](**options)


def registered() -> list[str]:
    return sorted(_REGISTRY)


@analyzer("text")
def _text(stop: bool = True, synonyms: dict[str, list[str]] | None = None, stem: Callable[[Column], Column] | str | None = None, markup: bool = False, protected: Sequence[str] = ()) -> Analyzer:
    """Markup and entities resolved, romanized, lower-cased, split, without stop words; then synonyms and a stemmer where given (a function, or "english"), which leaves protected words as they are."""
    if stem == "english":
        from ancestra.functions.stem import stemmed as stem  # noqa: PLW0127

    def run(c: Column) -> Column:
        from ancestra.operators.nameservice import with_synonyms

        out = text.tokens(text.html_entities(text.strip_markup(c) if markup else c))
        out = text.without_stop_words(out) if stop else out
        out = with_synonyms(out, synonyms) if synonyms else out
        return F.transform(out, lambda x: F.when(x.isin(*protected), x).otherwise(stem(x)) if protected else stem(x)) if stem else out

    return run


@analyzer("wiki text")
def _wiki_text() -> Analyzer:
    """White-space pieces of the text without markup."""
    return lambda c: F.filter(F.split(text.strip_markup(c), r"\s+"), lambda x: x != "")


@analyzer("html entities")
def _entities() -> Analyzer:
    return lambda c: F.transform(F.split(c, r"\s+"), lambda x: text.html_entities(x))


@analyzer("romanize")
def _romanize() -> Analyzer:
    """Romanized white-space pieces; the terms end before one that is too long."""

    def run(c: Column) -> Column:
        parts = F.split(c, r"\s+")
        over = F.array_position(F.transform(parts, lambda x: F.length(x) > MOST_TERM), True)
        kept = F.when(over > 0, F.slice(parts, F.lit(1), (over - 1).cast("int"))).otherwise(parts)
        return F.transform(kept, lambda x: text.romanize(x))

    return run


@analyzer("name")
def _name() -> Analyzer:
    return lambda c: names.name_tokens(c)


@analyzer("date")
def _date() -> Analyzer:
    return lambda c: dates.date_tokens(dates.date_words(c))


@analyzer("year")
def _year() -> Analyzer:
    return lambda c: dates.year_tokens(dates.date_words(c))


@analyzer("place index")
def _place_index() -> Analyzer:
    """A place and all its ancestors, reversed."""
    return lambda c: place.ancestors(F.lower(text.romanize(place.reversed_place(c))))


@analyzer("place query")
def _place_query() -> Analyzer:
    return lambda c: F.array(c)


@analyzer("place title")
def _place_title() -> Analyzer:
    return lambda c: F.array(F.lower(text.romanize(place.reversed_place(c))))


@analyzer("first letter")
def _first_letter() -> Analyzer:
    return lambda c: F.array(text.first_letter(c))


@analyzer("truncate")
def _truncate(length: int = 80) -> Analyzer:
    return lambda c: F.array(text.truncated(c, length))


@analyzer("unabbreviate")
def _unabbreviate(abbreviations: dict[str, str] | None = None, first_token: bool = True, ignore_case: bool = True) -> Analyzer:
    known = data.PLACE_ABBREVIATIONS if abbreviations is None else abbreviations
    return lambda c: text.unabbreviated(F.split(c, r"\s+"), known, first_token, ignore_case)


@analyzer("keyword")
def _keyword() -> Analyzer:
    return lambda c: F.array(c)


#: From the kind of a field (plans.analyze.kind) to its analyzer on the index side.
BY_KIND = {"text": "text", "name": "name", "date": "date", "year": "year", "place": "place index", "place title": "place title", "exact": "keyword"}

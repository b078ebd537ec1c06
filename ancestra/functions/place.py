"""Place text: levels, reversal, ancestor expansion, cleansing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ancestra import data

from .text import col, let, literal_map

_STATES = "|".join(s.lower() for s in data.US_STATES)
_STATES_BUT_GEORGIA = "|".join(s.lower() for s in data.US_STATES if s != "Georgia")

# Ordered replacements of place text.
CLEANSE = (
    (r",(\S)", ", $1"), (r"\s\s+", " "), (r", (, )+", ", "), (r"(^[, ]+)|([, ]+$)", ""), (r"(?i)\s+tws?p\.?,", " (township),"), (r"(?i)\s+par\.?,", " Parish,"),
    (r"(?i)\s+co\.?,", " County,"), (r"(?i)^prob\.?\s+", "probably "), (r"(?i)^poss\.?\s+", "possibly "), (rf"(?i)(^|, )({_STATES_BUT_GEORGIA})$", "$1$2, United States"),
    (r"(?i)(^|, )u\.?s\.?(a\.?)?$", "$1United States"), (r"(?i)(^|, )united states of america$", "$1United States"),
)
COUNTY = ((rf"(?i)\s+(county|parish), ({_STATES})\b", ", $2"),)
END = (
    (r"(<|&lt;)/?s(>|&gt;)|(<|&lt;)/?b(>|&gt;)|(<|&lt;)/?u(>|&gt;)|(<|&lt;)/?i(>|&gt;)", ""), (r"<|&lt;|>|&gt;", ""), (r", (\d+|\d+-\d+)$", ""), (r", (\d+|\d+-\d+), ", ", "),
    (r"(?i)(^|, )u\.?s\.?(a\.?)?$", "$1United States"),
)
WARD = ((rf"(?i)(ward|district|justice precinct|precinct)\s\d+, (.*, ({_STATES}))\b", "$2"),)
DETAIL = ((r"(?i)^(of|near|prob\.?|poss\.?|probably|possibly)\s+", ""), (r"^\d[^,]*,", ""), (r"\w*\d\w*", ""), (r"([, ]+$)", ""))
ZIP = r"^(\d+|\d+-\d+)$"


def _replaced(c: Column, rules) -> Column:
    for pattern, by in rules:
        c = F.regexp_replace(c, pattern, by)
    return c


def levels(c: Column | str) -> Column:
    """Comma-separated levels without the white space around commas; empty levels at the end are dropped."""
    return F.split(F.regexp_replace(col(c), r"(?:\s*,\s*)+$", ""), r"\s*,\s*", -1)


def filled_levels(c: Column | str) -> Column:
    """Levels, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(col(c), ",", -1), lambda x: F.trim(x)), lambda x: x != "")


def reversed_place(c: Column | str) -> Column:
    """Levels from the widest to the narrowest, joined by commas without spaces."""
    return F.array_join(F.reverse(filled_levels(c)), ",")


def place_level(reversed_c: Column | str) -> Column:
    return F.size(F.split(col(reversed_c), ","))


def ancestors(reversed_c: Column | str) -> Column:
    """A reversed place and all its ancestors, the longest first."""
    parts = F.split(col(reversed_c), ",", -1)
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), ","))


def facet_path(c: Column | str) -> Column:
    """Reversed levels with the mark of a place that has no subordinate."""
    return F.concat(reversed_place(c), F.lit("," + data.NO_SUBPLACE))


def place_facets(c: Column | str, countries: Column) -> Column:
    """(place0, place1, place2): hierarchical prefixes, level 2 in the United States alone; all null unless the widest level is one of `countries` (an array)."""
    path = F.reverse(filled_levels(c))
    marked = F.concat(path, F.array(F.lit(data.NO_SUBPLACE)))
    known = F.array_contains(countries, F.get(path, 0))
    prefix = lambda n: F.array_join(F.slice(marked, 1, n), ",")
    return F.struct(
        F.when(known, F.get(path, 0)).alias("place0"), F.when(known, prefix(2)).alias("place1"),
        F.when(known & (F.get(path, 0) == "United States") & (F.size(path) >= 2), prefix(3)).alias("place2"),
    )


def state_of(c: Column | str) -> Column:
    """The US state of an abbreviation; dots go and spaces are squeezed. Null for none."""
    return F.try_element_at(literal_map(data.STATE_BY_ABBREVIATION), F.lower(F.trim(F.regexp_replace(F.replace(col(c), F.lit("."), F.lit("")), r"\s+", " "))))


def cleansed(c: Column | str) -> Column:
    return _replaced(col(c), CLEANSE)


def cleansed_us(c: Column | str) -> Column:
    """A US state's abbreviation at the end, or before only the country and a zip code, as its name and the United States; counties before a state lose their word."""
    return let(col(c), _cleansed_us)


def _cleansed_us(c: Column) -> Column:
    parts = levels(c)
    last = [F.trim(F.try_element_at(parts, F.lit(-i))) for i in (1, 2, 3)]
    is_zip = [F.coalesce(x.rlike(ZIP), F.lit(False)) for x in last]
    skip = [F.coalesce(F.lower(x).rlike(r"^(united states|u\.?s\.?(a\.?)?)$"), F.lit(False)) | z for x, z in zip(last, is_zip, strict=True)]
    skip = [skip[0], skip[0] & skip[1], skip[0] & skip[1] & skip[2]]
    passed = sum((s.cast("int") for s in skip), F.lit(0))
    zip_code = F.coalesce(*[F.when(s & z, x) for x, s, z in reversed(list(zip(last, skip, is_zip, strict=True)))])
    at = F.size(parts) - passed
    state = state_of(F.trim(F.when(at >= 1, F.get(parts, at - 1))))
    made = F.concat(F.array_join(F.concat(F.slice(parts, F.lit(1), F.greatest(at - 1, F.lit(0))), F.array(state, F.lit("United States"))), ", "), F.coalesce(F.concat(F.lit(", "), zip_code), F.lit("")))
    return _replaced(F.when(state.isNotNull(), made).otherwise(c), COUNTY)


def lookup_text(c: Column | str) -> Column:
    """Place text as it is looked up: cleansed, without zip codes, wards, addresses, modifiers and words with digits."""
    return F.trim(_replaced(_replaced(cleansed_us(_replaced(cleansed(c), END)), WARD), DETAIL))


def consistent(a: Column | str, b: Column | str) -> Column:
    """Whether each level of a is, ignoring case, a level of b at the same place or later."""
    la, lb = levels(a), levels(b)
    return F.forall(F.transform(la, lambda x, i: F.exists(F.slice(lb, i + 1, F.greatest(F.size(lb), F.lit(1))), lambda y: F.lower(y) == F.lower(x))), lambda ok: ok)


def parent_place(c: Column | str) -> Column:
    """What follows the first comma, with its space; null without a comma."""
    at = F.instr(col(c), ",")
    return F.when(at > 0, F.substr(col(c), at + 1))


def no_subordinate(c: Column | str) -> Column:
    return F.concat(F.lit(data.NO_SUBPLACE + ", "), col(c))

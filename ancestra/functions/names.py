"""Personal and family names: pieces of titles, sort names, name tokens, initials, facets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ancestra import data

from .text import col, mixed_case, record, remove_index_number, romanize


def name_tokens(c: Column | str) -> Column:
    """Tokens of a name: white-space pieces, lower-cased, romanized, letters a to z alone; empty ones go."""
    return F.filter(F.transform(F.split(F.lower(col(c)), r"\s+", -1), lambda x: F.regexp_replace(romanize(x), "[^a-z]", "")), lambda x: x != "")


def name_pieces(c: Column | str) -> Column:
    """(given, surname): the first word and the rest; either null where missing."""
    parts = F.split(F.trim(remove_index_number(c)), " ", 2)
    blank = lambda x: F.when(F.trim(x) != "", x)
    return record(given=blank(F.get(parts, 0)), surname=blank(F.get(parts, 1)))


def family_pieces(c: Column | str) -> Column:
    """(husband, wife) name pieces of a family's title."""
    halves = F.split(remove_index_number(c), " and ", 2)
    return record(husband=name_pieces(F.get(halves, 0)), wife=name_pieces(F.get(halves, 1)))


def reversed_title(c: Column | str) -> Column:
    """"Surname, Given" of a person's title; unknown parts are Unknown, and a title that is unknown alone stays."""
    bare = F.trim(remove_index_number(c))
    p = name_pieces(c)
    return F.when(F.lower(bare) == data.UNKNOWN, "Unknown").when(p["surname"].isNull(), F.concat(F.lit("Unknown, "), p["given"])).otherwise(F.concat_ws(", ", p["surname"], p["given"]))


def reversed_family_title(c: Column | str) -> Column:
    """"Surname, Given and Surname, Given" of a family's title."""
    halves = F.split(remove_index_number(c), " and ", 2)
    one = lambda x: F.coalesce(reversed_title(x), F.lit("Unknown"))
    return F.concat(one(F.get(halves, 0)), F.lit(" and "), one(F.get(halves, 1)))


def full_name(prefix: Column, given: Column, surname: Column, suffix: Column) -> Column:
    """Prefix, given name (or a blank), surname, suffix."""
    filled = lambda x: F.when(F.trim(x) != "", x)
    return F.concat_ws(" ", filled(prefix), F.coalesce(filled(given), F.lit("___")), filled(surname), filled(suffix))


def reversed_full_name(prefix: Column, given: Column, surname: Column, suffix: Column) -> Column:
    """"Surname, Prefix Given, Suffix"; a missing surname is Unknown."""
    filled = lambda x: F.when(F.trim(x) != "", x)
    first = F.concat_ws(" ", filled(prefix), filled(given))
    return F.concat_ws(", ", F.coalesce(filled(surname), F.lit("Unknown")), F.when(first != "", first), filled(suffix))


def surname_index(sort_name: Column | str) -> Column:
    """The first letter of the romanized part before the comma; "other" where it begins beyond the alphabet, U without a letter."""
    part = F.upper(romanize(F.substring_index(col(sort_name), ",", 1)))
    letter = F.regexp_extract(part, "([A-Z])", 1)
    return F.when(part.rlike(r"^[^A-Z]*[^\x00-\x7F]") & ~part.rlike(r"^[^A-Z\x80-\x{10FFFF}]*[A-Z]"), "other").when(letter == "", "U").otherwise(letter)


def initials(c: Column | str) -> Column:
    """First letters of the words, joined by spaces."""
    return F.array_join(F.transform(F.filter(F.split(col(c), r"\s+"), lambda x: x != ""), lambda x: F.substring(x, 1, 1)), " ")


def capped_names(names: Column | str, cap: int = 100) -> Column:
    """The first names, up to and with the one at which their lengths reach the cap."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(col(names), start, lambda s, x: F.when(s["n"] >= cap, s).otherwise(F.struct((s["n"] + F.length(x)).alias("n"), F.concat(s["out"], F.array(x)).alias("out"))), lambda s: s["out"])


def name_facet(tokens: Column | str, known: Column) -> Column:
    """Known tokens in mixed case, others as Other, sorted and joined by bars; none as Unknown. known: an array of tokens."""
    each = F.array_sort(F.array_distinct(F.transform(col(tokens), lambda x: F.when(F.array_contains(known, x), mixed_case(x)).otherwise("Other"))))
    return F.when(F.size(each) == 0, "Unknown").otherwise(F.array_join(each, "|"))


def country_state(places: Column | str, countries: Column) -> Column:
    """(country, state) facets of an array of places: distinct values, sorted and joined by bars; country is Unknown and state null where there is none."""
    split = F.transform(col(places), lambda p: F.filter(F.transform(F.split(p, ",", -1), lambda x: F.trim(x)), lambda x: x != ""))
    good = F.filter(split, lambda x: F.array_contains(countries, F.try_element_at(x, F.lit(-1))))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), "|")
    country = joined(F.transform(good, lambda x: F.element_at(x, -1)))
    state = joined(F.transform(good, lambda x: F.concat(F.element_at(x, -1), F.lit(", "), F.coalesce(F.try_element_at(x, F.lit(-2)), F.lit("Unknown")))))
    return F.struct(F.when(country == "", "Unknown").otherwise(country).alias("country"), F.when(state != "", state).alias("state"))


def soundex_code(c: Column | str) -> Column:
    return F.soundex(col(c))

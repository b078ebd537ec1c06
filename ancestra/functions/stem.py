"""A stemmer for English terms: Porter's suffix stripping (Program 14, 1980) as a Column expression.

A stem's measure m is its number of vowel-consonant sequences; each step strips or replaces a
suffix where the measure of what is before it is large enough. Terms that aren't of a to z, and
those of one or two letters, stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The algorithm's consonants and vowels, conditions and suffixes.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
POSITIVE = f"^({_C})?{_V}{_C}"
ONE = f"^({_C})?{_V}{_C}({_V})?$"
MORE = f"^({_C})?{_V}{_C}{_V}{_C}"
VOWEL = f"^({_C})?[aeiouy]"
SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"
DOUBLE = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|yy)$"
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _without(x: Column, n: int) -> Column:
    return F.left(x, F.length(x) - n)


def _plural(x: Column) -> Column:
    return F.when(x.rlike("(ss|i)es$"), _without(x, 2)).when(x.rlike("[^s]s$"), _without(x, 1)).otherwise(x)


def _past(x: Column) -> Column:
    def mended(y: Column) -> Column:
        return F.when(y.rlike("(at|bl|iz)$"), F.concat(y, F.lit("e"))).when(y.rlike(DOUBLE), _without(y, 1)).when(y.rlike(SHORT), F.concat(y, F.lit("e"))).otherwise(y)

    def stripped(n: int) -> Column:
        return F.when(_without(x, n).rlike(VOWEL), _bound(_without(x, n), mended)).otherwise(x)

    eed = F.when(_without(x, 3).rlike(POSITIVE), _without(x, 1)).otherwise(x)
    return F.when(x.endswith("eed"), eed).when(x.endswith("ed"), stripped(2)).when(x.endswith("ing"), stripped(3)).otherwise(x)


def _last_y(x: Column) -> Column:
    return F.when(x.endswith("y") & _without(x, 1).rlike(VOWEL), F.concat(_without(x, 1), F.lit("i"))).otherwise(x)


def _replaced(suffixes: dict[str, str], condition: str) -> Callable[[Column], Column]:
    """The longest of the suffixes replaced where the stem before it meets the condition."""
    found = f"({'|'.join(suffixes)})$"
    new = F.create_map(*[F.lit(v) for pair in suffixes.items() for v in pair])

    def step(x: Column) -> Column:
        def put(s: Column) -> Column:
            stem = F.left(x, F.length(x) - F.length(s))
            good = stem.rlike(condition) & ((s != "ion") | stem.rlike("[st]$"))
            return F.when((s != "") & good, F.concat(stem, F.try_element_at(new, s))).otherwise(x)

        return _bound(F.regexp_extract(x, found, 1), put)

    return step


def _last_e(x: Column) -> Column:
    stem = _without(x, 1)
    return F.when(x.endswith("e") & (stem.rlike(MORE) | (stem.rlike(ONE) & ~stem.rlike(SHORT))), stem).otherwise(x)


def _last_l(x: Column) -> Column:
    return F.when(x.endswith("ll") & _without(x, 1).rlike(MORE), _without(x, 1)).otherwise(x)


def stemmed(term: Column) -> Column:
    """The stem of a lower-case term. A y at the beginning is a consonant, and is a capital meanwhile."""
    steps = (_plural, _past, _last_y, _replaced(SECOND, POSITIVE), _replaced(THIRD, POSITIVE), _replaced(dict.fromkeys(FOURTH, ""), MORE), _last_e, _last_l)

    def run(i: int, x: Column) -> Column:
        return x if i == len(steps) else _bound(steps[i](x), lambda y: run(i + 1, y))

    return F.when(term.rlike("^[a-z]{3,}$"), F.lower(run(0, F.regexp_replace(term, "^y", "Y")))).otherwise(term)


def sql(term: str) -> list[str]:
    """The steps in DuckDB's SQL, each over a column x of the step before."""
    def cut(n: int) -> str:
        return f"left(x, length(x) - {n})"

    def has(e: str, p: str) -> str:
        return f"regexp_matches({e}, '{p}')"

    def mended(n: int) -> str:
        y = cut(n)
        return f"CASE WHEN NOT {has(y, VOWEL)} THEN x WHEN {has(y, '(at|bl|iz)$')} THEN {y} || 'e' WHEN {has(y, DOUBLE)} THEN {cut(n + 1)} WHEN {has(y, SHORT)} THEN {y} || 'e' ELSE {y} END"

    def replaced(suffixes: dict[str, str], condition: str) -> str:
        s = f"regexp_extract(x, '({'|'.join(suffixes)})$', 1)"
        stem = f"left(x, length(x) - length({s}))"
        new = "CASE " + s + " " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in suffixes.items()) + " END"
        return f"CASE WHEN {s} <> '' AND {has(stem, condition)} AND ({s} <> 'ion' OR {has(stem, '[st]$')}) THEN {stem} || {new} ELSE x END"

    return [
        f"regexp_replace({term}, '^y', 'Y')", f"CASE WHEN {has('x', '(ss|i)es$')} THEN {cut(2)} WHEN {has('x', '[^s]s$')} THEN {cut(1)} ELSE x END",
        f"CASE WHEN suffix(x, 'eed') THEN CASE WHEN {has(cut(3), POSITIVE)} THEN {cut(1)} ELSE x END WHEN suffix(x, 'ed') THEN {mended(2)} WHEN suffix(x, 'ing') THEN {mended(3)} ELSE x END",
        f"CASE WHEN suffix(x, 'y') AND {has(cut(1), VOWEL)} THEN {cut(1)} || 'i' ELSE x END", replaced(SECOND, POSITIVE), replaced(THIRD, POSITIVE), replaced(dict.fromkeys(FOURTH, ""), MORE),
        f"CASE WHEN suffix(x, 'e') AND ({has(cut(1), MORE)} OR ({has(cut(1), ONE)} AND NOT {has(cut(1), SHORT)})) THEN {cut(1)} ELSE x END",
        f"CASE WHEN suffix(x, 'll') AND {has(cut(1), MORE)} THEN {cut(1)} ELSE x END", "lower(x)",
    ]

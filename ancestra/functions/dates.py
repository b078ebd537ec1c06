"""Date tokens: partial dates as yyyy, yyyyMM or yyyyMMdd, from free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ancestra import data

from .text import col, literal_map, record

YEAR = r"^(?:[0-2]\d{3}|\d{3})$"
DAY = r"^(?:0?[1-9]|[12]\d|3[01])$"
MONTH_NUMBER = r"^(?:0?[1-9]|1[0-2])$"


def date_words(c: Column | str) -> Column:
    """Lower-cased words of a date."""
    return F.filter(F.split(F.lower(col(c)), "[^a-z0-9]+"), lambda x: x != "")


def is_year(x: Column) -> Column:
    return x.rlike(YEAR)


def year_tokens(words: Column | str) -> Column:
    """All words that look like years."""
    return F.filter(col(words), is_year)


def date_tokens(words: Column | str) -> Column:
    """Standard dates of the words: one for each segment that has a year.

    "or" after a year ends a segment; one before it does nothing. In a segment the first year,
    month word and certain day win; a number that may be a month is taken for the month where
    no month word is given, else for the day; a number right after a year is ignored. A segment
    goes through one fold over the words, inside the JVM.
    """
    months = literal_map(data.MONTHS)
    none = F.lit(None).cast("string")
    names = ("year", "month", "day", "maybe")
    empty = record(**{n: none for n in names}, last=none, out=F.array().cast("array<string>"))

    def finished(s: Column) -> Column:
        month = F.coalesce(s["month"], F.lpad(s["maybe"], 2, "0"))
        spare = F.when(s["month"].isNotNull(), s["maybe"])
        day = F.lpad(F.coalesce(s["day"], spare), 2, "0")
        made = F.concat(F.lpad(s["year"], 4, "0"), F.when(month.isNotNull(), F.concat(month, F.coalesce(day, F.lit("")))).otherwise(""))
        return F.when(s["year"].isNotNull(), F.concat(s["out"], F.array(made))).otherwise(s["out"])

    def step(s: Column, w: Column) -> Column:
        ends = (w == "or") & s["year"].isNotNull()
        month = F.try_element_at(months, w)
        year_now = is_year(w)
        number = ~year_now & month.isNull() & w.rlike(DAY) & ~F.coalesce(is_year(s["last"]), F.lit(False))
        maybe = number & w.rlike(MONTH_NUMBER)
        keep = lambda n, new: F.when(ends, none).otherwise(F.coalesce(s[n], new))
        return record(
            year=keep("year", F.when(year_now, w)), month=keep("month", F.when(~year_now, month)), day=keep("day", F.when(number & ~maybe, w)), maybe=keep("maybe", F.when(maybe, w)),
            last=F.when(ends, none).otherwise(w), out=F.when(ends, finished(s)).otherwise(s["out"]),
        )

    return F.aggregate(col(words), empty, step, finished)


def century_decade(c: Column | str) -> Column:
    """(century, decade) of the first year in a date; years before 1600 and of three digits are "pre1600" without a decade."""
    year = F.regexp_extract(col(c), r"\b([012]?\d{3})\b", 1)
    early = (F.length(year) < 4) | (F.substring(year, 1, 2) < "16")
    has = F.coalesce(year, F.lit("")) != ""
    return record(
        century=F.when(has, F.when(early, "pre1600").otherwise(F.concat(F.substring(year, 1, 2), F.lit("00")))),
        decade=F.when(has & ~early, F.concat(F.substring(year, 1, 3), F.lit("0"))),
    )


def highlight_terms(token: Column | str) -> Column:
    """What of a date token is highlighted: the year, the month's name and its first three letters, the day without a zero."""
    t = col(token)
    names = F.array(*[F.lit(m) for m in data.HIGHLIGHT_MONTHS])
    month = F.try_element_at(names, F.substring(t, 5, 2).try_cast("int"))
    day = F.substring(t, 7, 2).try_cast("int")
    parts = F.array(F.when(F.length(t) >= 4, F.substring(t, 1, 4)), F.when(F.length(t) >= 6, month), F.when(F.length(t) >= 6, F.substring(month, 1, 3)), F.when((F.length(t) >= 8) & (day > 0), day.cast("string")))
    return F.array_compact(parts)

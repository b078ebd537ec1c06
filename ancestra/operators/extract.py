"""From wiki pages to documents: declarative XML extraction and the fields that titles and texts give.

The XML at a page's head is parsed once a row, in Arrow batches, into a map of field values
(native XPath drops empty elements and fails the query on malformed XML). All else is Column
expressions over that map.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ancestra import data
from ancestra.functions import dates, names, place, text

PRE, POST, LINK = "after bar", "before bar", "link"
BIRTH = ("Birth", "Baptism", "Christening", "Alt Birth", "Alt Christening")
CHRISTENING = ("Christening", "Baptism")
DEATH = ("Death", "Burial", "Alt Death", "Alt Burial")
MARRIAGE = ("Marriage", "Marriage Banns", "Alt Marriage")


@dataclass(frozen=True)
class Instruction:
    """One extraction: elements below the root and an attribute of each ("" for the element's text); types limit event_fact elements."""

    name: str
    paths: tuple[str, ...]
    default: str | None = None
    cut: str | None = None
    types: tuple[str, ...] = ()
    not_types: tuple[str, ...] = ()
    first: bool = False
    where: tuple[str, str] | None = None


def _i(name: str, *paths: str, **options) -> Instruction:
    return Instruction(name, paths, **options)


def _generic(*extra: Instruction, surname: str = "surname", where: str = "place") -> tuple[Instruction, ...]:
    return (_i("OtherSurname", surname), _i("OtherPlace", where, cut=POST), _i("SurnameStored", surname), _i("PlaceStored", where, cut=PRE), *extra)


_YEARS = (_i("FromYear", "from_year"), _i("ToYear", "to_year"))


def _event(name: str, attribute: str, types: tuple[str, ...], **options) -> Instruction:
    return _i(name, f"event_fact/@{attribute}", types=types, **options)


def _spouse(who: str, label: str) -> tuple[Instruction, ...]:
    stored = tuple(_i(f"{label}{n}DateStored", f"{who}/@{a}date", first=True) for n, a in (("Birth", "birth"), ("Chr", "chr"), ("Death", "death"), ("Burial", "burial")))
    return (_i(f"{label}BirthDate", f"{who}/@birthdate", f"{who}/@chrdate", default=data.NO_DATE), *stored[:2], _i(f"{label}DeathDate", f"{who}/@deathdate", f"{who}/@burialdate", default=data.NO_DATE), *stored[2:])


#: Root element and extractions of each namespace.
INSTRUCTIONS: dict[str, tuple[str, tuple[Instruction, ...]]] = {
    "Article": ("article", _generic(*_YEARS)),
    "Transcript": ("transcript", _generic(*_YEARS)),
    "Category": ("category", _generic()),
    "User": ("user", _generic(surname="researching/@surname", where="researching/@place")),
    "MySource": ("mysource", _generic(_i("Author", "author"), *_YEARS)),
    "Repository": ("repository", (_i("OtherPlace", "place", cut=POST), _i("PlaceStored", "place", cut=PRE))),
    "Source": ("source", _generic(
        _i("Author", "author", cut=LINK), _i("SourceTitleStored", "source_title"), _i("SourceSubject", "source_category"), _i("SourceSubject", "subject"),
        _i("SourceAvailability", "repository/@availability"), _i("SourceSubSubject", "ethnicity"), _i("SourceSubSubject", "religion"), _i("SourceSubSubject", "occupation"), *_YEARS)),
    "Surname": ("surname", (_i("RelatedName", "related/@name"),)),
    "Givenname": ("givenname", (_i("RelatedName", "related/@name"),)),
    "Image": ("image_data", (_i("OtherSurname", "person/@surname"), _i("OtherGivenname", "person/@given"), _i("OtherPlace", "place", cut=POST), _i("PlaceStored", "place", cut=PRE), _i("_FamilyTitle", "family/@title"))),
    "Place": ("place", (_i("PlaceName", "alternate_name/@name"), _i("PlaceName", "type"), _i("PlaceType", "type"), _i("Latitude", "latitude"), _i("Longitude", "longitude"), _i("_AlsoLocatedIn", "also_located_in/@place"))),
    "Person": ("person", (
        _i("PersonSurname", "name/@surname", "alt_name/@surname", "name/@title_suffix", "alt_name/@title_suffix"), _i("PersonGivenname", "name/@given", "alt_name/@given", "name/@title_prefix", "alt_name/@title_prefix"),
        _i("PersonGender", "gender"), _event("PersonBirthDate", "date", BIRTH, default=data.NO_DATE), _event("PersonBirthDateStored", "date", ("Birth",)), _event("PersonChrDateStored", "date", CHRISTENING),
        _event("PersonBirthPlace", "place", BIRTH, default=data.UNKNOWN, cut=POST), _event("PersonBirthPlaceStored", "place", ("Birth",), cut=PRE), _event("PersonChrPlaceStored", "place", CHRISTENING, cut=PRE),
        _event("PersonDeathDate", "date", DEATH, default=data.NO_DATE), _event("PersonDeathDateStored", "date", ("Death",)), _event("PersonBurialDateStored", "date", ("Burial",)),
        _event("PersonDeathPlace", "place", DEATH, default=data.UNKNOWN, cut=POST), _event("PersonDeathPlaceStored", "place", ("Death",), cut=PRE), _event("PersonBurialPlaceStored", "place", ("Burial",), cut=PRE),
        _i("OtherPlace", "event_fact/@place", not_types=BIRTH + DEATH, cut=POST), _i("ParentFamilyTitle", "child_of_family/@title"), _i("SpouseFamilyTitle", "spouse_of_family/@title"),
        _i("PrimaryImage", "image/@filename", where=("primary", "true")), _i("_Given", "name/@given", "alt_name/@given"))),
    "Family": ("family", (
        _i("HusbandSurname", "husband/@surname"), _i("HusbandGivenname", "husband/@given"), _i("WifeSurname", "wife/@surname"), _i("WifeGivenname", "wife/@given"), *_spouse("husband", "Husband"), *_spouse("wife", "Wife"),
        _event("MarriageDate", "date", MARRIAGE, default=data.NO_DATE), _event("MarriageDateStored", "date", ("Marriage",)), _event("BannsDateStored", "date", ("Marriage Banns",)),
        _event("MarriagePlace", "place", MARRIAGE, default=data.UNKNOWN, cut=POST), _event("MarriagePlaceStored", "place", ("Marriage",), cut=PRE), _event("BannsPlaceStored", "place", ("Marriage Banns",), cut=PRE),
        _i("OtherPlace", "event_fact/@place", not_types=MARRIAGE, cut=POST), _i("ChildTitle", "child/@title"), _i("PrimaryImage", "image/@filename", where=("primary", "true")))),
}


def cut_value(value: str, how: str | None) -> str:
    import re

    if how == PRE:
        return value.partition("|")[2] if "|" in value else value
    if how == POST:
        return value.partition("|")[0]
    if how == LINK:
        bare = value.replace("[[", "").replace("]]", "")
        head, bar, tail = bare.partition("|")
        return re.sub(r"\(\d+\)$", "", bare) if not bar else tail or bare
    return value


def values_of(root: ET.Element, i: Instruction) -> list[str]:
    """All values of an instruction in document order."""
    wanted: dict[str, list[str]] = {}
    for p in i.paths:
        element, _, attribute = p.partition("/@")
        wanted.setdefault(element, []).append(attribute)
    out, seen = [], set()
    for e in root:
        if e.tag not in wanted or (i.first and e.tag in seen):
            continue
        seen.add(e.tag)
        kind = e.get("type")
        if i.types and kind not in i.types or i.not_types and (kind is None or kind in i.not_types) or i.where and e.get(i.where[0]) != i.where[1]:
            continue
        if wanted[e.tag] == [""]:
            out.append("".join(e.itertext()))
        else:
            out += [e.get(a) for a in e.attrib if a in wanted[e.tag]]
    return out


def _full(e: ET.Element) -> str:
    parts = [e.get("title_prefix"), e.get("given") or "___", e.get("surname"), e.get("title_suffix")]
    return " ".join(p for p in parts if p)


def _sorted_full(e: ET.Element) -> str:
    first = " ".join(x for x in (e.get("title_prefix"), e.get("given")) if x)
    return ", ".join(x for x in (e.get("surname") or "Unknown", first, e.get("title_suffix")) if x)


def parse(namespace: str, xml: str) -> dict[str, list[str]] | None:
    """Field values of a page's XML; null if there is none, it is malformed, or the namespace has no extraction."""
    if not xml or namespace not in INSTRUCTIONS:
        return None
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return None
    tag, instructions = INSTRUCTIONS[namespace]
    if root.tag != tag:
        root = ET.Element(tag)
    out: dict[str, list[str]] = {}
    for i in instructions:
        found = [cut_value(v, i.cut) for v in values_of(root, i)] or ([i.default] if i.default is not None else [])
        out.setdefault(i.name, []).extend(found)
    if namespace == "Person":
        out["_Name"] = [_sorted_full(e) for e in root.findall("name")[:1]]
        out["_AltName"] = [f"{e.get('type') or ''}\x1f{e.get('surname') or ''}\x1f{_full(e)}" for e in root.findall("alt_name")]
    out["_Sourced"] = ["1"] if any(True for t in ("source_citation", "image", "note") for _ in root.iter(t)) else []
    return {k: v for k, v in out.items() if v}


VALUES = T.MapType(T.StringType(), T.ArrayType(T.StringType()))


@F.pandas_udf(VALUES)
def xml_values(namespace: pd.Series, xml: pd.Series) -> pd.Series:
    return pd.Series([parse(n, x) for n, x in zip(namespace, xml, strict=True)], dtype=object)


def _empty() -> Column:
    return F.array().cast("array<string>")


def _got(name: str) -> Column:
    return F.coalesce(F.try_element_at("v", F.lit(name)), _empty())


def _first(name: str) -> Column:
    return F.get(_got(name), 0)


def _unknown(x: Column) -> Column:
    return F.coalesce(F.when(F.trim(x) != "", x), F.lit(data.UNKNOWN))


def _piece(side: str, part: str):
    """A name part of one spouse in a family's title."""
    return lambda x: _unknown(names.family_pieces(x)[side][part])


def with_values(pages: DataFrame) -> DataFrame:
    """pages (page_id, full_title, rev_timestamp, popularity, contents, users, trees) with the common fields, their XML's values v, and no redirects."""
    split = text.namespace_title("full_title")
    base = pages.where(~F.coalesce(text.is_redirect("contents"), F.lit(False))).withColumn("_s", split)
    base = base.withColumns({"NamespaceStored": F.col("_s.namespace"), "TitleStored": F.col("_s.title"), "Namespace": text.main_namespace(F.col("_s.namespace")), "contents": F.replace(F.coalesce("contents", F.lit("")), F.lit("<show_sources_images_notes/>"), F.lit(""))})
    base = base.withColumn("TalkNamespace", F.when(F.col("NamespaceStored").endswith(" talk") | (F.col("NamespaceStored") == "Talk"), True))
    tags = F.create_map(*[F.lit(x) for n, (tag, _) in INSTRUCTIONS.items() for x in (n, tag)])
    tag = F.try_element_at(tags, F.when(F.col("TalkNamespace").isNull(), F.col("Namespace")))
    close = F.concat(F.lit("</"), tag, F.lit(">"))
    end = F.coalesce(F.call_function("locate", close, F.col("contents")), F.lit(0))
    cut_at = end + F.length(close)
    base = base.withColumns({"_xml": F.when(end > 0, F.substr("contents", F.lit(1), cut_at - 1)).otherwise(""), "TextStored": F.when(end > 0, F.substr("contents", cut_at)).otherwise(F.col("contents"))})
    return base.withColumn("v", xml_values("Namespace", "_xml")).drop("_s")


def documents(pages: DataFrame, countries: Column | None = None) -> DataFrame:
    """One wide document per page that isn't a redirect; multi-valued fields are arrays, unset flags null."""
    p = with_values(pages)
    countries = F.array(F.lit("United States"), F.lit("England")) if countries is None else countries
    fields: dict[str, Column] = {
        "PageId": F.col("page_id").cast("string"), "LastModDate": F.col("rev_timestamp"), "Popularity": F.col("popularity").cast("int"), "User": F.coalesce("users", _empty()), "Tree": F.coalesce("trees", _empty()),
        "Category": text.category_links("contents"), "Keywords": F.array("full_title", "contents"),
    }
    for n in dict.fromkeys(i.name for _, instructions in INSTRUCTIONS.values() for i in instructions if not i.name.startswith("_")):
        fields[n] = _got(n)
    ns, title, has = F.col("Namespace"), F.col("TitleStored"), F.col("v").isNotNull()
    person, family = (ns == "Person") & F.col("TalkNamespace").isNull(), (ns == "Family") & F.col("TalkNamespace").isNull()
    pieces = lambda x: names.family_pieces(x)
    parents, spouses = _got("ParentFamilyTitle"), _got("SpouseFamilyTitle")
    for who, side in (("Father", "husband"), ("Mother", "wife")):
        for part, label in (("given", "Givenname"), ("surname", "Surname")):
            got = F.transform(parents, _piece(side, part))
            fields[who + label] = F.when(person & has, F.when(F.size(got) == 0, F.array(F.lit(data.UNKNOWN))).otherwise(got)).otherwise(_empty())
    gender = F.coalesce(_first("PersonGender"), F.lit("?"))
    for part, label in (("given", "Givenname"), ("surname", "Surname")):
        got = F.when(gender == "M", F.transform(spouses, _piece("wife", part))).when(gender != "?", F.transform(spouses, _piece("husband", part))).otherwise(_empty())
        fields["Spouse" + label] = F.when(person & has, F.when(F.size(got) == 0, F.array(F.lit(data.UNKNOWN))).otherwise(got)).otherwise(_empty())
    married = F.array_distinct(F.filter(F.transform(spouses, lambda x: _unknown(pieces(x)["husband"]["surname"])), lambda x: x != data.UNKNOWN))
    fields["PersonMarriedName"] = F.when(person & has & ~gender.isin("?", "M"), married).otherwise(_empty())
    own = names.name_pieces(title)
    fields["PersonSurname"] = F.when(person & has & (F.size(fields["PersonSurname"]) == 0), F.array(_unknown(own["surname"]))).otherwise(fields["PersonSurname"])
    given = F.filter(F.transform(_got("_Given"), lambda x: names.initials(x)), lambda x: x != "")
    fields["PersonGivenname"] = F.when(person & has & (F.size(fields["PersonGivenname"]) == 0), F.array(_unknown(own["given"]))).otherwise(F.concat(fields["PersonGivenname"], F.when(person, given).otherwise(_empty())))
    alt = F.transform(_got("_AltName"), lambda x: F.split(x, "\x1f"))
    alt = F.filter(alt, lambda x: ~((F.get(x, 0) == "Married Name") & F.array_contains(fields["PersonMarriedName"], F.get(x, 1))))
    fields["AltnameStored"] = names.capped_names(F.transform(alt, lambda x: F.get(x, 2)))
    both = pieces(title)
    for who, side in (("Husband", "husband"), ("Wife", "wife")):
        for part, label in (("given", "Givenname"), ("surname", "Surname")):
            fields[who + label] = F.when(family & has & (F.size(fields[who + label]) == 0), F.array(_unknown(both[side][part]))).otherwise(fields[who + label])
    stored = F.when(person, F.coalesce(_first("_Name"), names.reversed_title(title))).when(family, F.concat(_spouse_sorted("Husband", both["husband"], fields), F.lit(" and "), _spouse_sorted("Wife", both["wife"], fields)))
    stored = F.when((ns == "Person") & ~person, names.reversed_title(title)).when((ns == "Family") & ~family, names.reversed_family_title(title)).otherwise(stored)
    fields["FullnameStored"] = F.when(ns == "Image", F.array_join(F.transform(_got("_FamilyTitle"), lambda x: names.reversed_family_title(x)), "; ")).otherwise(stored)
    fields["SurnameIndexFacet"] = F.when(ns.isin("Person", "Family"), names.surname_index(F.when(ns == "Person", names.reversed_title(title)).otherwise(names.reversed_family_title(title))))
    fields["Unsourced"] = F.when((person | family) & has & (F.size(_got("_Sourced")) == 0) & text.is_blank("TextStored"), True)
    places = F.filter(F.concat(fields["PersonBirthPlace"], fields["PersonDeathPlace"]), lambda x: x != data.UNKNOWN)
    facets = names.country_state(places, countries)
    fields["PersonCountryFacet"], fields["PersonStateFacet"] = F.when(person & has, facets["country"]), F.when(person & has, facets["state"])
    year = dates.century_decade(F.coalesce(_first("PersonBirthDateStored"), _first("PersonChrDateStored")))
    fields["PersonCenturyFacet"], fields["PersonDecadeFacet"] = F.when(person & has, year["century"]), F.when(person & has, year["decade"])
    is_place = (ns == "Place") & F.col("TalkNamespace").isNull()
    head = F.trim(F.substring_index(title, ",", 1))
    fields["PlaceName"] = F.when(is_place, F.array_compact(F.concat(F.array(head, text.umlauts(head)), fields["PlaceName"]))).otherwise(fields["PlaceName"])
    fields["LocatedInPlace"] = F.when(is_place, F.array_compact(F.concat(F.array(place.parent_place(title)), _got("_AlsoLocatedIn")))).otherwise(_empty())
    fields["PlaceTitle"] = F.when(is_place, title)
    fields["OtherPlace"] = F.when(is_place, F.array(title)).otherwise(fields["OtherPlace"])
    fields["Category"] = F.when(ns == "Category", F.array_append(fields["Category"], title)).otherwise(fields["Category"])
    fields["User"] = F.when(ns == "User", F.array_append(fields["User"], title)).otherwise(fields["User"])
    fields["SurnameTitle"], fields["GivennameTitle"] = F.when(ns == "Surname", title), F.when(ns == "Givenname", title)
    fields["OtherSurname"] = F.when(ns == "Surname", F.array(title)).when(ns == "Image", F.concat(fields["OtherSurname"], _family_parts("surname"))).otherwise(fields["OtherSurname"])
    fields["OtherGivenname"] = F.when(ns == "Givenname", F.array(title)).when(ns == "Image", F.concat(fields["OtherGivenname"], _family_parts("given"))).otherwise(fields["OtherGivenname"])
    fields["Title"] = F.when(ns == "Source", F.array_join(F.concat(F.array(title), fields["SourceTitleStored"]), " ")).otherwise(title)
    sort_name = F.when(person, names.reversed_title(title)).when(family, names.reversed_family_title(title)).otherwise(title)
    fields["TitleSort"] = F.concat(F.when(F.col("NamespaceStored") == "", "").otherwise(F.concat("NamespaceStored", F.lit(":"))), sort_name)
    fields["TitleFirstLetter"] = text.first_letter(sort_name)
    return p.select("NamespaceStored", "Namespace", "TalkNamespace", "TitleStored", "TextStored", *[c.alias(n) for n, c in fields.items()])


def _family_parts(part: str) -> Column:
    pairs = F.transform(_got("_FamilyTitle"), lambda x: F.array(names.family_pieces(x)["husband"][part], names.family_pieces(x)["wife"][part]))
    return F.array_compact(F.flatten(pairs))


def _spouse_sorted(who: str, default: Column, fields: dict[str, Column]) -> Column:
    given, surname = F.get(fields[f"{who}Givenname"], 0), F.get(fields[f"{who}Surname"], 0)
    known = lambda x: F.when(x != data.UNKNOWN, x)
    return F.coalesce(F.when(known(given).isNotNull() | known(surname).isNotNull(), F.concat_ws(", ", F.coalesce(known(surname), F.lit("Unknown")), known(given))), F.lit("Unknown"))


#: The columns of raw pages.
PAGES = "page_id string, full_title string, rev_id long, rev_timestamp string, popularity int, contents string, users array<string>, trees array<string>"

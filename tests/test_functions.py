"""Hand-derived values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from ancestra import data
from ancestra.functions import dates, names, place, text


def value(spark, make, x):
    return spark.createDataFrame([(x,)], "x string").select(make(F.col("x"))).first()[0]


CASES = [
    (text.romanize, "Straße", "Strasse"), (text.romanize, "Æ", "Ae"), (text.romanize, "é", "e"), (text.romanize, None, ""), (text.romanize, "abc", "abc"),
    (text.umlauts, "Köln", "Koeln"), (text.umlauts, "Paris", None), (text.mixed_case, "van dyke", "Van Dyke"),
    (text.html_entities, "A&nbsp;B&eacute;&amp;", "A Bé&amp;"), (text.html_entities, "&&x;&Eacute;", "&&x;É"),
    (text.title_case, "the history of the world: the end", "The History of the World: The End"), (text.title_case, "henry viii and de la Cruz", "Henry VIII and de la Cruz"),
    (text.place_level_case, "salem (TOWNSHIP)", "Salem (township)"), (text.first_letter, "smith", "S"), (text.first_letter, "Wilson", "WXYZ"),
    (text.first_letter, "álvarez", "other"), (text.first_letter, "1900", "other"), (text.after_bar, "A|B", "B"), (text.before_bar, "A|B", "A"),
    (text.link_text, "[[X (2)]]", "X "), (text.link_text, "[[X (2)|Y]]", "Y"), (text.link_text, "[[X|]]", "X|"),
    (text.strip_markup, '<a href="u v">t</a>', " u v t "), (text.to_ascii, "aé", "a?"), (text.is_redirect, "#REDIRECT [[X]]", True), (text.padded_title, "A (12)", "A  000012"),
    (lambda c: text.namespace_title(c)["title"], "Person:John Smith (5)", "John Smith (5)"), (lambda c: text.namespace_title(c)["namespace"], "Foo:Bar", ""),
    (text.main_namespace, "Talk", "Article"), (text.main_namespace, "Person talk", "Person"), (text.namespace_id, "MediaWiki talk", 8), (text.namespace_id, "User talk", 3),
    (lambda c: F.array_join(text.category_links(c), ";"), "x [[Category:Smith surname|s]] [[category:B]]", "Smith surname;B"),
    (place.reversed_place, "Provo, Utah, Utah, United States", "United States,Utah,Utah,Provo"), (place.reversed_place, "England", "England"),
    (place.reversed_place, "Kent,, England", "England,Kent"), (lambda c: F.array_join(place.ancestors(c), ";"), "united states,utah,provo", "united states,utah,provo;united states,utah;united states"),
    (place.cleansed, "Provo,Utah", "Provo, Utah, United States"), (place.cleansed, "U.S.A.", "United States"), (place.cleansed, "Salem twp, Ohio", "Salem (township), Ohio, United States"),
    (place.cleansed, "Kent co., England", "Kent County, England"), (place.lookup_text, "Provo, UT", "Provo, Utah, United States"), (place.lookup_text, "Utah County, Utah", "Utah, Utah, United States"),
    (place.lookup_text, "Ward 3, Provo, Utah", "Provo, Utah, United States"), (place.lookup_text, "prob. Boston", "Boston"), (place.lookup_text, "Provo, UT, 84601", "Provo, Utah, United States"),
    (place.lookup_text, "123 Main St, Provo, UT 84601", "Provo, UT"), (place.state_of, "N. Car.", "North Carolina"), (place.parent_place, "Kent, England", " England"),
    (lambda c: F.array_join(dates.date_tokens(dates.date_words(c)), ";"), "3 feb 1850", "18500203"), (lambda c: F.array_join(dates.date_tokens(dates.date_words(c)), ";"), "15 Mar 1900", "19000315"),
    (lambda c: F.array_join(dates.date_tokens(dates.date_words(c)), ";"), "1 2 1900", "190001"), (lambda c: F.array_join(dates.date_tokens(dates.date_words(c)), ";"), "13 4 1850", "18500413"),
    (lambda c: F.array_join(dates.date_tokens(dates.date_words(c)), ";"), "1963/4", "1963"), (lambda c: F.array_join(dates.date_tokens(dates.date_words(c)), ";"), "abt 950", "0950"),
    (lambda c: F.array_join(dates.date_tokens(dates.date_words(c)), ";"), "1850 or 1851", "1850;1851"), (lambda c: F.array_join(dates.date_tokens(dates.date_words(c)), ";"), "feb or mar 1850", "185002"),
    (lambda c: F.array_join(dates.date_tokens(dates.date_words(c)), ";"), "feb", ""), (lambda c: F.array_join(dates.date_tokens(dates.date_words(c)), ";"), "0000", "0000"),
    (lambda c: F.array_join(dates.date_tokens(dates.date_words(c)), ";"), "3000", ""), (lambda c: F.array_join(dates.year_tokens(dates.date_words(c)), ";"), "abt 950 or 1850", "950;1850"),
    (lambda c: dates.century_decade(c)["century"], "abt 1850", "1800"), (lambda c: dates.century_decade(c)["decade"], "abt 1850", "1850"), (lambda c: dates.century_decade(c)["century"], "1599", "pre1600"),
    (lambda c: dates.century_decade(c)["decade"], "950", None), (lambda c: dates.century_decade(c)["decade"], "2010", "2010"),
    (lambda c: F.array_join(dates.highlight_terms(c), ","), "18500203", "1850,febuary,feb,3"),
    (names.reversed_title, "John Smith (5)", "Smith, John"), (names.reversed_title, "Unknown", "Unknown"), (names.reversed_title, "John", "Unknown, John"),
    (names.reversed_family_title, "John Smith and Unknown", "Smith, John and Unknown"), (names.surname_index, "Smith, John", "S"), (names.surname_index, "Ødegaard, X", "O"),
    (names.surname_index, "山田, 太郎", "other"), (names.surname_index, "123, X", "U"), (names.surname_index, "Unknown", "U"), (names.initials, "John Henry", "J H"),
    (lambda c: names.family_pieces(c)["wife"]["surname"], "Robert Smith and Mary Jones", "Jones"), (lambda c: F.array_join(names.name_tokens(c), ","), "O'Brien Müller", "obrien,muller"),
]


@pytest.mark.parametrize("make, x, want", CASES, ids=range(len(CASES)))
def test_values(spark, make, x, want):
    assert value(spark, make, x) == want


FACETS = [
    ("Provo, Utah, Utah, United States", ("United States", "United States,Utah", "United States,Utah,Utah")),
    ("Utah, United States", ("United States", "United States,Utah", "United States,Utah,(no subordinate)")),
    ("England", ("England", "England,(no subordinate)", None)), ("Kent, England", ("England", "England,Kent", None)), ("Atlantis", (None, None, None)),
]


@pytest.mark.parametrize("x, want", FACETS)
def test_place_facets(spark, x, want):
    known = F.array(F.lit("United States"), F.lit("England"))
    assert tuple(value(spark, lambda c: place.place_facets(c, known), x)) == want


@pytest.mark.parametrize("a, b, want", [("Provo, Utah", "Provo, Utah, Utah, United States", True), ("Utah, Provo", "Provo, Utah", False), ("X", "Provo", False)])
def test_consistent(spark, a, b, want):
    assert value(spark, lambda c: place.consistent(c, F.lit(b)), a) is want


def test_tables():
    assert len(data.LATIN1_ENTITIES) == 96 and len(data.US_STATES) == 51 and len(data.NAMESPACES) == 18


def test_sql_functions(spark):
    from ancestra.functions import register

    made = register.register(spark)
    assert len(made) >= 16
    row = spark.sql("SELECT g_romanize('Straße é') a, g_us_state('N. Car.') b, g_reversed_title('John Smith (5)') c, g_century('abt 1850') d, g_is_redirect('#redirect [[X]]') e").first()
    assert tuple(row) == ("Strasse e", "North Carolina", "Smith, John", "1800", True)
    assert [tuple(r) for r in spark.sql("SELECT * FROM g_batch('a | b|')").collect()] == [(0, "a"), (1, "b"), (2, "")]
    assert register.apply("initials", spark.createDataFrame([("van dyke",)], "x string"), "x", "i").first().i == "v d"

"""The query language, its rewrites and scores."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ancestra.operators import search as S
from ancestra.plans.ast import Options, Popularity, show
from ancestra.plans.compile import Compiler
from ancestra.plans.parser import ParseError, parse, parse_strict
from ancestra.plans.rewrites import highlight_terms, popularity, rewritten

INVALID = "(+Keywords:invalidquery)"


def after(q, **options):
    o = Options(**options)
    tree = rewritten(parse(q, o), o)
    return show(tree) if o.exact else show(tree.clauses[0][1])


@pytest.mark.parametrize("q, want", [
    ("a1 b2", "(Keywords:a1 Keywords:b2)"), ("+a1 -b2", "(+Keywords:a1 -Keywords:b2)"), ("a1 AND b2", "(+Keywords:a1 +Keywords:b2)"), ("a1 OR b2", "(Keywords:a1 Keywords:b2)"), ("NOT a1 b2", "(-Keywords:a1 Keywords:b2)"),
    ('Title:"x1 y2"^2', '(+Title:"x1 y2"^2)'), ("Title:(x1 y2)", "(+(Title:x1 Title:y2))"), ("smit*", "(+Keywords:smit*)"), ("s*th?x", "(+Keywords:s*th?x)"), ("a*b?", INVALID), ("ab*", INVALID), ("ab~", INVALID), ("", INVALID), ("(a1", INVALID),
    ("PersonBirthYear:[1850 TO 1860]", "(+PersonBirthYear:[1850 TO 1860])"), ("PersonBirthDate:[1850 TO 1861]", INVALID), ("Title:[1 TO 2]", INVALID), ("PersonBirthYear:185*", INVALID), ("PersonBirthPlace:prov*", INVALID),
    ("PersonBirthDate:1850", "(+PersonBirthDate:1850)"), ('PersonBirthDate:"3 feb 1850"', "(+PersonBirthDate:18500203)"), ("Müller", "(+Keywords:muller)"),
])
def test_parse(q, want):
    assert show(parse(q)) == want


def test_default_operator():
    assert show(parse("a1 b2", Options(sort="x"))) == "(+Keywords:a1 +Keywords:b2)"
    assert show(parse("a1 b2", Options(sort="x", default_operator="OR"))) == "(Keywords:a1 Keywords:b2)"
    with pytest.raises(ParseError):
        parse_strict(" ".join(f"w{i}" for i in range(1100)), Options())


@pytest.mark.parametrize("q, options, want", [
    ("PersonBirthDate:\"feb 1850\"", {}, "(+(PersonBirthDate:[185002 TO 18500299] | PersonBirthDate:1850^0.4))"),
    ("PersonBirthDate:[1850 TO 1855]", {}, "(+PersonBirthYear:[1850 TO 1855]^0.4)"),
    ('PersonBirthDate:"3 feb 1850"', {}, "(+(PersonBirthDate:18500203 | PersonBirthDate:185002^0.6 | PersonBirthDate:1850^0.4))"),
    ('+PersonSurname:"van dyke"', {"exact": True}, "(+PersonSurname:van +PersonSurname:dyke)"),
    ("Surname:smith", {"exact": True}, "(+(PersonSurname:smith | HusbandSurname:smith | WifeSurname:smith | OtherSurname:smith))"),
    ("Surname:smith", {"exact": True, "filters": (("Namespace", "Person"),)}, "(+PersonSurname:smith)"),
    ("Surname:smith", {"exact": True, "filters": (("Namespace", "Source"),)}, "(+OtherSurname:smith)"),
    ("Surname:smit*", {"exact": True}, "(+(PersonSurname:smit* HusbandSurname:smit* WifeSurname:smit* OtherSurname:smit*))"),
    ("Surname:smit* Title:q1", {"exact": True}, "(PersonSurname:smit* HusbandSurname:smit* WifeSurname:smit* OtherSurname:smit* Title:q1)"),
    ("Place:Nowhere", {}, "(+Place:nowhere,*)"), ('Place:"Nowhere, Atlantis" Title:q1', {}, "(Title:q1)"),
    ("Keywords:census", {}, "(Title:census^0.5 +Keywords:census^0.5)"),
    ("PersonSurname:smith", {"related_names": lambda n, s: ["smyth"]}, "(+(PersonSurname:smyth^0.99 | PersonMarriedName:smith^0.33 | PersonSurname:smith^1.65) Title:smith^0.1)"),
    ("PersonSurname:unknown", {}, "(+PersonSurname:unknown^1.65)"), ("PlaceName:salem", {}, "(+PlaceName:salem~0.65)"),
    ('OtherPlace:"a"', {"match_places": lambda t: ["P, U, S"]}, '(+(OtherPlace:"s,u,(no subordinate)"^0.5 | OtherPlace:"s,(no subordinate)"^0.2 | OtherPlace:"s,u,p"^0.8))'),
    ('OtherPlace:"a"', {"match_places": lambda t: ["P, S"], "filters": (("Namespace", "Source"),)}, '(+OtherPlace:"s,p,(no subordinate)"^0.8)'),
    ('OtherPlace:"a"', {"match_places": lambda t: ["P, S"], "filters": (("Namespace", "Source"),), "sub": True}, '(OtherPlace:"s,p,(no subordinate)" +OtherPlace:"s,p"^0.5)'),
    ('Place:"a"', {"match_places": lambda t: ["P", "Q"], "exact": True, "filters": (("Namespace", "Person"),)}, "(+(PersonBirthPlace:p | PersonDeathPlace:p | PersonBirthPlace:q | PersonDeathPlace:q))"),
])
def test_rewrites(q, options, want):
    assert after(q, **options) == want


def test_popularity_and_places_echo():
    o = Options(match_places=lambda t: ["P", "Q"])
    tree = rewritten(parse("OtherPlace:x1", o), o)
    assert o.place_matches == {"OtherPlace": ["P", "Q"]} and isinstance(tree.clauses[1][1], Popularity)
    assert popularity(tree, Options(exact=True)) is tree


def test_highlight_terms():
    got = highlight_terms(parse('PersonBirthDate:"3 feb 1850" Keywords:"x1 y2" MarriageYear:[1850 TO 1852]'))
    assert got["PersonBirthDateStored"] == ["1850", "febuary", "feb", "3"] and got["TextStored"] == ["x1", "y2"] and got["MarriageDateStored"] == ["1850", "1851", "1852"]


ROWS = [
    ("1", ["smith"], [], ["smith"], 512, ["18500203"], ["census"]), ("2", [], ["smith"], [], 0, ["1850"], []), ("3", ["smyth"], [], [], 0, ["185002"], ["census"]), ("4", ["jones"], [], [], 1024, ["1851"], []),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "PageId string, PersonSurname array<string>, PersonMarriedName array<string>, Title array<string>, Popularity int, PersonBirthDate array<string>, Keywords array<string>").cache()


def scores(docs, q, **options):
    r = S.search(docs, q, Options(**options), rows=50, facets=("PersonSurname",))
    return {x.PageId: round(x.score, 6) for x in r.docs.collect()}, r


def test_scores(docs):
    near = {"related_names": lambda n, s: ["smyth"]}
    got, r = scores(docs, "PersonSurname:smith", **near)
    assert got == {"1": 2.25, "2": 0.33, "3": 0.99}
    assert {x.value: x["count"] for x in r.facets["PersonSurname"].collect()} == {"smith": 1, "smyth": 1}
    assert scores(docs, "PersonSurname:smith", exact=True)[0] == {"1": 1.0}
    assert scores(docs, 'PersonBirthDate:"3 feb 1850"')[0] == {"1": 1.5, "2": 0.4, "3": 0.6}
    assert scores(docs, "-PersonSurname:smith +PersonSurname:jones", exact=True)[0] == {"4": 1.0}
    assert scores(docs, "]bad", exact=True)[0] == {}


def test_unknown_field_and_paging(docs):
    assert docs.where(Compiler(docs).match(parse("Nowhere:x1"))).count() == 0
    r = S.search(docs, "PersonSurname:smith PersonSurname:jones PersonSurname:smyth", Options(exact=True), start=1, rows=1)
    assert [x.PageId for x in r.docs.collect()] == ["3"]


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet='ab*?+-"()[]:^~ 1\\', max_size=14))
def test_any_text_parses(q):
    tree = parse(q)
    assert tree.clauses and show(tree)
    assert show(rewritten(tree, Options(exact=True)))


def test_highlighted(spark):
    df = spark.createDataFrame([("The cat, the CAT; catalog",)], "t string")
    got = df.select(S.highlighted(F.col("t"), ["cat"]), S.highlighted(F.col("t"), ["dog"]), F.array_join(S.fragments(F.col("t"), ["cat"], 5, 9), "|"), S.alternate_text(F.array(F.lit("a"), F.lit("b")), 3)).first()
    assert got[0] == "The <b>cat</b>, the <b>CAT</b>; catalog" and got[1] is None and "<b>cat</b>" in got[2] and got[3] == "a; "


def test_fragments_by_different_words_and_marks_by_offsets(spark):
    text = "one cat here. a cat and a cat again. the Dog saw one cat near. nothing at all of it. dog"
    got = spark.range(1).select(S.best_fragments(F.lit(text), ["cat", "dog"], 22, 2), S.best_fragments(F.lit(text), ["bird"], 22, 2), S.best_fragments(F.lit(None).cast("string"), ["cat"])).first()
    assert got[0][0].lower().count("<b>") >= 2 and "<b>Dog</b>" in got[0][0] and got[1] is None and got[2] is None
    df = spark.createDataFrame([("abcdef", [(4, 5), (0, 2), (1, 3), (4, 5)]), ("abc", []), ("abc", [(0, 3)]), ("abcd", [(0, 1), (1, 2), (0, 4)])], "t string, s array<struct<start:int,end:int>>")
    assert [r[0] for r in df.select(S.marked_spans(F.col("t"), F.col("s"))).collect()] == ["<b>abc</b>d<b>e</b>f", None, "<b>abc</b>", "<b>abcd</b>"]

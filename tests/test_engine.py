"""From pages to search results, end to end."""

import pytest
from pyspark.sql import functions as F

from ancestra import catalog
from ancestra.engine import Engine, data_quality, event_dates
from ancestra.functions import analysis
from ancestra.operators import extract, index
from ancestra.operators import places as P
from ancestra.plans.ast import Options

from .test_extract import PERSON
from .test_places import ROWS

catalog.load()


@pytest.fixture(scope="module")
def engine(spark):
    rows = [
        ("1", "Person:John Smith (5)", PERSON), ("2", "Person:Ann Smyth (1)", "<person><name given='Ann' surname='Smyth'/><event_fact type='Birth' date='1850' place='Utah, United States'/></person>"),
        ("3", "Family:A B and C D (2)", "<family><event_fact type='Marriage' date='4 Feb 1900' place='Kent, England|Kent'/></family>"), ("4", "Article:The census", "the census of <b>Kent</b>"), ("5", "Talk:Census", "#REDIRECT [[X]]"),
    ]
    pages = spark.createDataFrame([(i, t, 1, "20200101000000", 512 if i == "1" else 0, c, ["u"], []) for i, t, c in rows], extract.PAGES)
    places = spark.createDataFrame(ROWS, P.SCHEMA)
    redirects = spark.createDataFrame([("Old Kent, England", "Kent, England")], "source string, target string")
    docs = index.standardized_places(extract.documents(pages), redirects, P.indexed(places))
    variants = spark.createDataFrame([("smith", ["smyth"], [])], "name string, confirmed array<string>, computer array<string>")
    universe = spark.createDataFrame([("smith", True)], "name string, common boolean")
    return Engine(index.build(docs).cache(), places, variants, universe)


def found(r):
    return {x.PageId: round(x.score, 4) for x in r.docs.collect()}


def test_names_dates_and_keywords(engine):
    assert found(engine.search("PersonSurname:smith", Options(exact=True))) == {"1": 1.0}
    assert found(engine.search("PersonSurname:smith")) == {"1": pytest.approx(1.65 + 0.1 + 0.5), "2": pytest.approx(0.99)}
    assert found(engine.search('PersonBirthDate:"3 Feb 1850"', Options(exact=True))) == {"1": 1.0}
    assert set(found(engine.search("PersonBirthYear:[1849 TO 1851]", Options(exact=True)))) == {"1", "2"}
    assert set(found(engine.search("MarriageYear:1900"))) == {"3"} and set(found(engine.search("FatherGivenname:robert"))) == {"1"}
    assert set(found(engine.search("census", Options(filters=(("Namespace", "Article"),))))) == {"4"}


@pytest.mark.parametrize("options", [Options(exact=True), Options(exact=True, sort="Popularity")])
def test_all_that_match(spark, options):
    n = 100_250
    docs = spark.range(n + 9).select(F.col("id").alias("PageId"), F.when(F.col("id") < n, F.array(F.lit("smith"))).alias("PersonSurname"), (F.col("id") * 7919 % 5).cast("int").alias("Popularity"))
    ids = lambda start, rows: [r.PageId for r in Engine(docs).search("PersonSurname:smith", options, start=start, rows=rows).docs.select("PageId").collect()]
    every = ids(0, None)
    assert sorted(every) == list(range(n))
    assert every == ids(0, 2 * n) and ids(100_100, None) == every[100_100:] and ids(2 * n, None) == []


def test_engine_search_has_no_limit(spark, tmp_path):
    """More than a page of customers match, and no plan of the query keeps but some of them."""
    spark.range(400).selectExpr("id AS c_custkey", "if(id < 390, 'BUILDING', 'MACHINERY') AS c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    out = catalog.QUERIES["engine_search"](spark, str(tmp_path))
    assert "Limit" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.page_id for r in out.collect()} == {str(i) for i in range(390) if 40 <= i % 100 <= 45}


def test_places_widen_both_ways(engine):
    r = engine.search('PersonBirthPlace:"Utah, US"')
    assert set(found(r)) == {"1", "2"}  # a wide place finds all below it
    assert set(found(engine.search('PersonBirthPlace:"Provo, Utah"'))) == {"1", "2"}  # and a narrow one those filed at exactly a wider place
    assert set(found(engine.search('PersonBirthPlace:"Provo, Utah"', Options(exact=True)))) == {"1"}
    r = engine.search('Place:"Salem"')
    assert r.place_matches == {"Place": ["Salem, Ohio, United States", "Salem, Kent, England"]}


def test_facets_stats_highlights(engine):
    r = engine.search("+PersonSurname:smith", facets=("PersonCenturyFacet", "PersonSurname"))
    assert {x.value: x["count"] for x in r.facets["PersonSurname"].collect()} == {"smith": 1, "jr": 1, "smyth": 2}
    assert engine.stats()["total"].first().total == 4 and engine.watched("u").first()["count"] == 4
    assert "FullnameStored" in r.highlights


def test_place_facets_and_services(spark, engine):
    docs = spark.createDataFrame([("1", ["Provo, Utah, Utah, United States", "Kent, England"])], "PageId string, OtherPlace array<string>")
    row = index.place_facets(docs, F.array(F.lit("United States"), F.lit("England")), ("OtherPlace",)).first()
    assert row.Place0 == ["United States", "England"] and row.Place1 == ["United States,Utah", "England,Kent"] and row.Place2 == ["United States,Utah,Utah"]
    assert engine.name_info(spark.createDataFrame([("smith",)], "name string")).first().confirmed == ["smyth"]
    got = {r.q: r for r in event_dates(spark.createDataFrame([("3 Feb 1850",), ("abt 900",), ("?",)], "q string")).collect()}
    assert (got["3 Feb 1850"].iso, got["3 Feb 1850"].sort_key, got["abt 900"].iso, got["abt 900"].year_only, got["?"].error) == ("1850-02-03", "18500203", "0900", True, "no year")
    assert [tuple(r) for r in data_quality(docs, {"many places": F.size("OtherPlace") > 1, "none": F.size("OtherPlace") == 0}).collect()] == [("1", "many places")]


@pytest.mark.parametrize("name, value, want", [
    ("text", "The caf&eacute; of Kent", ["cafe", "kent"]), ("name", "O'Brien", ["obrien"]), ("date", "3 Feb 1850", ["18500203"]), ("year", "1850 or 1851", ["1850", "1851"]), ("place index", "Kent, England", ["england,kent", "england"]),
    ("place query", "Kent", ["Kent"]), ("place title", "Kent, England", ["england,kent"]), ("first letter", "zoo", ["WXYZ"]), ("truncate", "a" * 90, ["a" * 80]), ("unabbreviate", "kent co", ["kent", "county"]), ("keyword", "A b", ["A b"]),
    ("wiki text", "<p class=\"x y\">hi</p>", ["x", "y", "hi"]), ("romanize", "é " + "z" * 2000 + " b", ["e"]), ("html entities", "a&eacute; b", ["aé", "b"]),
])
def test_analyzers(spark, name, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(analysis.make(name)(F.col("v"))).first()[0] == want
    assert name in analysis.registered()

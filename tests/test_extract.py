"""Documents of small pages of each kind."""

from ancestra.operators import extract

PERSON = """<person><name given="John Henry" surname="Smith" title_suffix="Jr"/>
<alt_name type="Alt Name" given="Jack" surname="Smyth"/><gender>M</gender>
<child_of_family title="Robert Smith and Mary Jones (3)"/>
<spouse_of_family title="John Smith and Anna Lee (1)"/>
<event_fact type="Birth" date="3 Feb 1850" place="Provo, Utah, Utah, United States|Provo"/>
<event_fact type="Death" date="abt 1901" place="Kent, England"/></person>
[[Category:Smith surname]] text"""


def docs(spark, *rows):
    pages = spark.createDataFrame([(str(i), t, 1, "20200101000000", 5, c, ["u"], []) for i, (t, c) in enumerate(rows)], extract.PAGES)
    return {r.PageId: r for r in extract.documents(pages).collect()}


def test_person(spark):
    d = docs(spark, ("Person:John Smith (5)", PERSON))["0"]
    want = {
        "FatherGivenname": ["Robert"], "FatherSurname": ["Smith"], "MotherGivenname": ["Mary"], "MotherSurname": ["Jones"], "SpouseGivenname": ["Anna"], "SpouseSurname": ["Lee"], "PersonMarriedName": [],
        "PersonSurname": ["Smith", "Jr", "Smyth"], "PersonGivenname": ["John Henry", "Jack", "J H", "J"], "AltnameStored": ["Jack Smyth"], "FullnameStored": "Smith, John Henry, Jr", "TitleSort": "Person:Smith, John",
        "SurnameIndexFacet": "S", "PersonCountryFacet": "England|United States", "PersonStateFacet": "England, Kent|United States, Utah", "PersonCenturyFacet": "1800", "PersonDecadeFacet": "1850",
        "PersonBirthPlace": ["Provo, Utah, Utah, United States"], "PersonBirthPlaceStored": ["Provo"], "Category": ["Smith surname"], "Unsourced": None, "PersonBirthDate": ["3 Feb 1850"], "OtherPlace": [],
    }
    assert {k: d[k] for k in want} == want


def test_defaults_malformed_and_redirects(spark):
    got = docs(
        spark, ("Person:Ann Lee", "<person><gender>F</gender><spouse_of_family title='Bob Ray and Ann Lee'/></person>"), ("Person:X Y", "<person><broken></person>"), ("Person:Z", "#redirect [[Person:Q]]"),
        ("Family:A B and C D (2)", "<family><husband given='A' surname='B' birthdate='1800'/></family>hello"), ("Foo:Bar", "just text"), ("Talk:T", "x"), ("Person talk:John Smith (5)", "hm"),
    )
    ann = got["0"]
    assert (ann.PersonSurname, ann.PersonGivenname, ann.PersonMarriedName, ann.PersonBirthDate, ann.Unsourced, ann.SpouseGivenname) == (["Lee"], ["Ann"], ["Ray"], ["0000"], True, ["Bob"])
    assert got["1"].PersonBirthDate == [] and got["1"].FatherSurname == []
    assert "2" not in got
    f = got["3"]
    assert (f.WifeGivenname, f.WifeSurname, f.HusbandBirthDate, f.WifeBirthDate, f.FullnameStored, f.TextStored) == (["C"], ["D"], ["1800"], ["0000"], "B, A and D, C", "hello")
    assert (got["4"].Namespace, got["4"].TitleStored, got["5"].Namespace, got["5"].TalkNamespace, got["6"].FullnameStored) == ("Article", "Foo:Bar", "Article", True, "Smith, John")


def test_other_kinds(spark):
    got = docs(
        spark, ("Place:Köln, Preußen", "<place><alternate_name name='Cologne'/><type>City</type><latitude>50.9</latitude><also_located_in place='Rhineland'/></place>"), ("Source:S", "<source><source_title>T</source_title><author>[[X (2)]]</author><place>A|B</place></source>"),
        ("Surname:Smith", "<surname><related name='Smyth'/></surname>"), ("Image:I.jpg", "<image_data><person given='A' surname='B'/><family title='C D and E F'/></image_data>"), ("Category:Q", "x"), ("User:U", "<user><researching surname='R' place='P|p'/></user>"),
    )
    assert (got["0"].PlaceName, got["0"].LocatedInPlace, got["0"].Latitude, got["0"].OtherPlace) == (["Köln", "Koeln", "Cologne", "City"], [" Preußen", "Rhineland"], ["50.9"], ["Köln, Preußen"])
    assert (got["1"].Title, got["1"].Author, got["1"].OtherPlace, got["1"].PlaceStored) == ("S T", ["X "], ["A"], ["B"])
    assert (got["2"].RelatedName, got["2"].OtherSurname, got["2"].SurnameTitle) == (["Smyth"], ["Smith"], "Smith")
    assert (got["3"].OtherSurname, got["3"].OtherGivenname, got["3"].FullnameStored) == (["B", "D", "F"], ["A", "C", "E"], "D, C and F, E")
    assert got["4"].Category == ["Q"] and got["5"].User == ["u", "U"] and got["5"].OtherSurname == ["R"] and got["5"].PlaceStored == ["p"]


def test_rows_of_a_small_file_are_made_pages_by_all_tasks(spark, tmp_path):
    from ancestra.catalog import pages

    path = str(tmp_path / "customer.parquet")
    spark.range(10).selectExpr("id AS c_custkey", "'BUILDING' AS c_mktsegment").coalesce(1).write.parquet(path)
    found = pages.persons(lambda name: spark.read.parquet(path))
    assert "hashpartitioning(c_custkey" in found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert sorted(r.page_id for r in found.select("page_id").collect()) == [str(i) for i in range(10)]

"""Place resolution over a small hierarchy."""

import pytest

from ancestra.operators import places

ROWS = [
    ("United States", ["USA"], None, "Country", "39", "-98"), ("Utah, United States", [], None, "State", "40", "-111"), ("Utah, Utah, United States", [], None, "County", None, None), ("Provo, Utah, Utah, United States", [], None, "City", "40.2", "-111.6"),
    ("Georgia, United States", [], None, "State", None, None), ("Georgia (country)", ["Georgia"], None, "Country", None, None), ("England", [], None, "Country", "52", "-1"), ("Kent, England", [], ["Greater London, England"], "County", "bad", "0"),
    ("Salem, Ohio, United States", [], None, "City", None, None), ("Salem, Kent, England", [], None, "Town", None, None), ("Ohio, United States", [], None, "State", None, None), ("Boston, Kent, England", [], None, "Town", None, None),
]


@pytest.fixture(scope="module")
def index(spark):
    return places.indexed(spark.createDataFrame(ROWS, places.SCHEMA)).cache()


def asked(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, q string")


def test_matches(spark, index):
    texts = ["Provo, UT", "provo, utah, utah, united states", "Salem", "Georgia", "Nowhere, Kent, England", "Atlantis", "Salem, England", "prob. Boston", "Utah County, Utah"]
    got = {r.id: r for r in places.matches(asked(spark, *texts), index).collect()}
    assert got[0].titles == ["Provo, Utah, Utah, United States"] and got[1].titles == ["Provo, Utah, Utah, United States"]
    assert got[2].titles == ["Salem, Ohio, United States", "Salem, Kent, England"]
    assert got[3].titles == ["Georgia, United States", "Georgia (country)"]
    assert (got[4].titles, got[4].error, got[4].standard) == (None, "missing", "Nowhere, Kent, England")
    assert (got[5].error, got[5].standard) == ("missing", "Atlantis")
    assert got[6].titles == ["Salem, Kent, England"] and got[7].titles == ["Boston, Kent, England"] and got[8].titles == ["Utah, Utah, United States"]


def test_standardize(spark, index):
    got = {r.q: (r.result, r.error) for r in places.standardize(asked(spark, "Provo, UT", "Ward 3, Provo, Utah", "Nowhere^Provo, Utah", "Atlantis"), index).collect()}
    assert got["Provo, UT"] == ("Provo, Utah, Utah, United States", None)
    assert got["Ward 3, Provo, Utah"] == ("Provo, Utah, Utah, United States^Ward 3, Provo, Utah, Utah, United States", None)
    assert got["Nowhere^Provo, Utah"] == ("Provo, Utah, Utah, United States", None)
    assert got["Atlantis"] == ("Atlantis", "missing")


def test_default_country(spark, index):
    got = places.matches(asked(spark, "Kent, Nowhere"), index, "England").first()
    assert got.error is None or got.error == "missing"


def test_autocomplete_tokens_coordinates(spark, index):
    got = sorted(map(tuple, places.autocomplete(asked(spark, "sal", "salem, engl", "salem,"), index).collect()))
    assert [g[:2] for g in got] == [(0, "Salem, Kent, England"), (0, "Salem, Ohio, United States"), (1, "Salem, Kent, England"), (2, "Salem, Kent, England"), (2, "Salem, Ohio, United States")]
    tokens = places.index_tokens(spark.createDataFrame([("Kent, England",), ("X",)], "title string"), index).collect()
    assert [r.tokens for r in sorted(tokens)] == [["Kent, England", "Greater London, England"], ["X"]]
    at = {r.id: tuple(r)[1:] for r in places.coordinates(asked(spark, "Provo, Utah", "Utah, Utah, United States", "Kent, England", "Salem", "Atlantis", "Georgia (country)"), index).collect()}
    assert at[0] == (pytest.approx(40.2), pytest.approx(-111.6), 0) and at[1][:2] == (40.0, -111.0) and at[2][:2] == (52.0, -1.0)
    assert at[3] == (None, None, 3) and at[4] == (None, None, 2) and at[5] == (None, None, 1)


def test_short_beginnings(spark, index):
    """First tokens of one and two letters complete, and whole tokens before the begun one count."""
    got = sorted(map(tuple, places.autocomplete(asked(spark, "sa", "bo", "pro", "ut", "united st", "kent, e"), index).select("id", "title").collect()))
    assert [g for g in got if g[0] == 0] == [(0, "Salem, Kent, England"), (0, "Salem, Ohio, United States")]
    assert [g[1] for g in got if g[0] == 1] == ["Boston, Kent, England"] and [g[1] for g in got if g[0] == 2] == ["Provo, Utah, Utah, United States"]
    assert [g[1] for g in got if g[0] == 3] == ["Utah, United States", "Utah, Utah, United States"] and [g[1] for g in got if g[0] == 4] == ["United States"]
    assert [g[1] for g in got if g[0] == 5] == ["Kent, England"]


def test_deep_texts(spark):
    """All levels of a text count, however many, and others' depth doesn't matter."""
    titles = [", ".join(f"Level{chr(97 + i)}" for i in range(n, -1, -1)) for n in range(9)]
    index = places.indexed(spark.createDataFrame([(t, [], None, "place", None, None) for t in titles], places.SCHEMA))
    got = {r.id: r for r in places.matches(asked(spark, *titles, "Nowhere, " + titles[8].lower(), ""), index).collect()}
    assert [got[i].titles for i in range(9)] == [[t] for t in titles]
    shuffled = {r.id: r for r in places.resolve(asked(spark, *[t.lower() for t in titles]).selectExpr("id", "q as lookup", "false as strict", "false as begun"), index).collect()}
    assert [shuffled[i].titles for i in range(9)] == [[t] for t in titles]
    assert got[9].error == "missing" and got[9].standard == "Nowhere, " + titles[8] and got[10].error == "missing"

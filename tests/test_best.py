"""The best documents, dictionaries and similar terms, against plain search and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from ancestra.operators import best as B
from ancestra.operators import postings as P
from ancestra.operators import search as S
from ancestra.operators import terms as D
from ancestra.plans.ast import MUST, Bool, Fuzzy, Options, Popularity, Prefix, Term, Wildcard

WORDS = ["smith", "smyth", "smithers", "reed", "read", "reading", "utah", "ohio", "una", "onth", "a", "ab", "aaaa", "aaa", "o'neil", "thing", "nothing"]
SCHEMA = "PageId long, Keywords array<string>, Title array<string>, Namespace string, Popularity int"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(7)
    rows = [(i, r.choices(WORDS, k=r.randrange(0, 30)), r.choices(WORDS, k=2), r.choice(["Person", "Place"]), r.choice([None, 0, int(r.paretovariate(0.6)) % 100_000])) for i in range(3000)]
    return spark.createDataFrame([*rows, (9000, None, None, None, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def table(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("postings"))
    P.write(docs, path, ("Keywords", "Title", "Namespace"), impact="Popularity")
    return P.read(spark, path)


@pytest.mark.parametrize("filters", [(), (("Namespace", "Person"),)])
@pytest.mark.parametrize("q", ["reed", "+reed -una", "reed smith^2.5", '"reed una"', "rea*", "+Title:ohio +Keywords:utah", "zzz", "-reed", "reed -smith Title:una^900"])
def test_same_as_search(docs, table, q, filters):
    o = Options(exact=True, filters=filters)
    for start, rows in ((0, 10), (5, 3), (2995, 50)):
        one, two = S.search(docs, q, o, start, rows).docs, B.search_best(docs, table, q, o, start, rows)
        assert two.columns == one.columns
        assert [(r.PageId, round(r.score, 9)) for r in one.collect()] == [(r.PageId, round(r.score, 9)) for r in two.collect()]


def test_all_that_match(docs, table):
    o = Options(exact=True)
    every, some = B.search_best(docs, table, "reed", o, rows=None).collect(), S.search(docs, "reed", o, rows=4000).docs.collect()
    assert [(r.PageId, r.score) for r in every] == [(r.PageId, r.score) for r in some] and len(every) > 1000
    assert [r.PageId for r in B.search_best(docs, table, "reed", o, 5, None).collect()] == [r.PageId for r in some[5:]]


def test_few_of_many_matches_are_scored(docs, table):
    tree = Bool(((MUST, Bool(((MUST, Term("Keywords", "reed")), ("", Popularity())))),))
    best = B.Best(docs, table)
    bound = best.bound(tree, 10)
    matched, scored = best.scored(tree).count(), best.scored(tree, bound).count()
    assert best.able(tree) and 10 <= scored < matched / 10 and matched > 1000
    plan = best.scored(tree, bound)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(impact," in plan.split("PushedFilters")[1]


def test_bounds():
    tree = Bool(((MUST, Term("Keywords", "a", 2.0)), ("", Popularity(0.5))))
    assert B.highest(tree, 1024) == 2.5 and B.needed(tree, 1.9, 5000) == float("-inf")
    assert B.needed(tree, 3.0, 5000) == pytest.approx(2048, abs=1e-3) and B.needed(tree, 3.0, 5000) <= 2048
    assert B.negative(Bool(((MUST, Term("a", "b", -1.0)),)))


@pytest.fixture(scope="module")
def words(spark, table, tmp_path_factory):
    return D.Terms(spark, str(tmp_path_factory.mktemp("terms"))).write(table)


def test_dictionary(docs, words):
    want = {r.value: r["count"] for r in S.facet(docs, "Keywords").collect()}
    assert {r.term: r.documents for r in words.terms().where("field = 'Keywords'").collect()} == want
    assert [r.term for r in words.completed("Keywords", "a", 3).collect()] == [w for w, _ in sorted(((w, n) for w, n in want.items() if w.startswith("a")), key=lambda x: (-x[1], x[0]))][:3]


LEAVES = [Wildcard("Keywords", p) for p in ("*ing", "?eed", "*", "*i*h*", "s*th", "*a", "?", "*hi?g", "*'n*", "*zz*", "*o")] + [Prefix("Keywords", "rea"), Term("Keywords", "una"), Fuzzy("Keywords", "smitz"), Fuzzy("Keywords", "thin", 0.6), Fuzzy("Keywords", "aa", 0.3), Fuzzy("Keywords", "zzzzzz")]


@pytest.mark.parametrize("leaf", LEAVES, ids=range(len(LEAVES)))
def test_lookups_equal_a_scan(spark, words, leaf):
    from ancestra.plans.compile import Compiler

    every = spark.createDataFrame([(w,) for w in WORDS], "term string")
    want = sorted(r.term for r in every.where(Compiler.test(leaf, F.col("term"))).collect())
    assert words.named(leaf) == want
    assert sorted(r.term for r in words.matching(leaf).collect()) == want


def test_a_leading_star_reads_a_few_pieces(words):
    assert D.pattern_grams("*hing") == ["hin", "ing", "ng\x03"] and D.pattern_grams("*a*") == [] and D.pattern_grams("?") == []
    plan = words.matching(Wildcard("Keywords", "*hing"))._jdf.queryExecution().toString()
    assert "In(gram, [" in plan or "Or(" in plan


@pytest.mark.parametrize("least", [0.3, 0.5, 0.65, 0.9])
def test_similar_terms_equal_brute_force(spark, least):
    r = random.Random(2)
    some = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 14))) for _ in range(250)} | {"a", "ab", "aaaaaaaa"})
    terms = spark.createDataFrame([("f", w, 1) for w in some], "field string, term string, documents long")
    asked = spark.createDataFrame([(w,) for w in [*some[::5], "", None, "cccccccccccccccccccc"]], "asked string")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = sorted((a, b) for a in [*some[::5], "c" * 20] for b in some if 1 - edits(a, b) / min(len(a), len(b)) > least)
    got = sorted((r.asked, r.term) for r in D.similar(asked, D.grams(terms), terms, least).collect())
    assert got == want

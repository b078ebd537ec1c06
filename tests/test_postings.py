"""Postings against the same queries over arrays of terms."""

import random

import pytest

from ancestra.operators import postings as P
from ancestra.operators import search as S
from ancestra.plans.ast import MUST, MUST_NOT, SHOULD, Bool, DisMax, Fuzzy, Options, Phrase, Popularity, Prefix, Range, Term, Wildcard
from ancestra.plans.compile import Compiler

WORDS = ["smith", "smyth", "reed", "read", "reading", "utah", "ohio", "una", "onth"]
SCHEMA = "PageId long, Keywords array<string>, Title array<string>, Namespace string, Popularity int"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(7)
    rows = [(i, r.choices(WORDS, k=r.randrange(0, 30)), r.choices(WORDS, k=2), r.choice(["Person", "Place"]), r.choice([None, 3, 500])) for i in range(200)]
    rows += [(900, None, None, None, None), (901, [], [], "Person", 1), (902, [None, "reed", None, "una"], ["reed"], "Place", 9), (903, ["reed"] * 5000, ["una"], "Person", 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def table(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("postings"))
    P.write(docs, path, ("Keywords", "Title", "Namespace"))
    return P.read(spark, path)


def test_rows_are_all_terms_with_their_places(docs, table):
    got = sorted((r.field, r.term, r.PageId, *r.positions) for r in table.collect())
    want = {}
    for d in docs.collect():
        for f, terms in (("Keywords", d.Keywords), ("Title", d.Title), ("Namespace", [d.Namespace])):
            for i, x in enumerate(x for x in terms or [] if x is not None):
                want.setdefault((f, x, d.PageId), []).append(i)
    assert got == sorted((*k, *v) for k, v in want.items())


QUERIES = ["reed", "+reed -una", "reed smith^2.5", '"reed una"', '+"una reed" smyth', "rea*", "+(re?d utah) -ohio", "Title:reed Nowhere:reed", "+Namespace:Person +reed", "reed +(-una)", "zzzz", "((", "-reed"]


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("q", QUERIES)
def test_same_documents_scores_and_pages(docs, table, q, exact):
    one, two = (S.search(docs, q, Options(exact=exact), rows=400, postings=p) for p in (None, table))
    assert two.docs.columns == one.docs.columns and two.matched.columns == one.matched.columns
    pairs = [[(r.PageId, round(r.score, 9)) for r in x.docs.collect()] for x in (one, two)]
    assert pairs[0] == pairs[1]
    assert one.summary.first().hits == two.summary.first().hits == len(pairs[0]) == two.matched.count()


TREES = [
    Bool(((MUST, Fuzzy("Keywords", "smith", 0.7)),)),
    DisMax((Fuzzy("Title", "reet", 0.5, 2.0), Term("Keywords", "una", 0.4))),
    DisMax((Popularity(), Term("Keywords", "una", 0.4))),
    Bool(((MUST, Popularity()), (MUST_NOT, Term("Keywords", "reed")))),
    Bool(((SHOULD, Phrase("Keywords", ("reed", "reed", "reed"))), (SHOULD, Phrase("Namespace", ("Per", "son"))))),
    Bool(((MUST_NOT, Term("Keywords", "reed")),)),
]


@pytest.mark.parametrize("tree", TREES, ids=range(len(TREES)))
def test_same_by_tree(docs, table, tree):
    c, p = Compiler(docs), P.Lookup(docs, tree, P.written_fields(table))
    plain = docs.where(c.match(tree)).select("PageId", c.score(tree).alias("s"))
    looked = p.joined(docs, table).where(p.match(tree)).select("PageId", p.score(tree).alias("s"))
    a, b = (sorted((r.PageId, round(r.s, 9)) for r in x.collect()) for x in (plain, looked))
    assert a == b


def test_facets(docs, table):
    matched = S.search(docs, "una", Options(exact=True), postings=table).matched
    for some in (docs, matched):
        want = {r.value: r["count"] for r in S.facet(some, "Keywords").collect()}
        assert {r.value: r["count"] for r in P.facet(table, "Keywords", some).collect()} == want
    assert {r.value: r["count"] for r in P.facet(table, "Keywords").collect()} == {r.value: r["count"] for r in S.facet(docs, "Keywords").collect()}


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_plans(docs, table):
    built = plan(P.postings(docs, ("Keywords", "Title")))
    assert built.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in built and "Aggregate" not in built  # besides the fixture's own repartition()
    tree = Bool(((MUST, Term("Keywords", "reed")),))
    read = plan(P.Lookup(docs, tree, P.written_fields(table)).found(table))
    assert "EqualTo(term,reed)" in read and "PartitionFilters: [isnotnull(field" in read and "positions" not in read


UNWRITTEN = [
    Term("Title", "reed"), Phrase("Title", ("reed", "una")), Prefix("Title", "rea"), Wildcard("Title", "r*d"), Range("Title", "re", "rf"), Fuzzy("Title", "reet", 0.5), Term("Namespace", "Person"),
    DisMax((Term("Title", "una"), Term("Keywords", "una", 0.5))), Term("Nowhere", "reed"),
]


@pytest.mark.parametrize("leaf", UNWRITTEN, ids=range(len(UNWRITTEN)))
def test_fields_without_postings_are_searched_in_the_arrays(spark, docs, tmp_path_factory, leaf):
    path = str(tmp_path_factory.mktemp("some"))
    P.write(docs, path, ("Keywords",))
    table = P.read(spark, path)
    assert P.written_fields(table) == ("Keywords",)
    other = Term("Keywords", "reed")
    for tree in (Bool(((MUST, leaf),)), Bool(((MUST, other), (MUST_NOT, leaf))), Bool(((SHOULD, other), (SHOULD, leaf))), Bool(((MUST, leaf), (MUST_NOT, other))), Bool(((MUST, other), (MUST, Bool(((MUST_NOT, leaf), (MUST, Popularity()))))))):
        c, p = Compiler(docs), P.Lookup(docs, tree, ("Keywords",))
        plain = docs.where(c.match(tree)).select("PageId", c.score(tree).alias("s"))
        looked = p.joined(docs, table).where(p.match(tree)).select("PageId", p.score(tree).alias("s"))
        a, b = (sorted((r.PageId, round(r.s, 9)) for r in x.collect()) for x in (plain, looked))
        assert a == b


def test_a_field_without_any_term_is_written_all_the_same(spark, tmp_path):
    docs = spark.createDataFrame([(1, ["a"], None), (2, None, None)], "PageId long, Keywords array<string>, Title array<string>")
    P.write(docs, str(tmp_path / "p"), ("Keywords", "Title"))
    table = P.read(spark, str(tmp_path / "p"))
    assert P.written_fields(table) == ("Keywords", "Title") and table.count() == 1
    assert S.search(docs, "Title:a", postings=table).docs.count() == 0


@pytest.mark.parametrize("keys", [(1, 1), (None, 2)])
def test_keys_must_be_distinct(spark, tmp_path, keys):
    docs = spark.createDataFrame([(k, ["a"]) for k in keys], "PageId long, Keywords array<string>")
    with pytest.raises(ValueError):
        P.write(docs, str(tmp_path / "p"), ("Keywords",))


def test_a_table_whose_fields_are_not_known_is_an_error(docs, table):
    with pytest.raises(ValueError):
        S.search(docs, "reed", postings=table.selectExpr("field", "concat(term, '') as term", "PageId", "positions"))


def test_empty_table(spark, docs, tmp_path):
    P.write(docs.limit(0), str(tmp_path / "p"), ("Keywords", "Title"))
    none = P.postings(docs.limit(0), ("Keywords", "Title"))
    assert S.search(docs.limit(0), "reed", postings=none).docs.collect() == []


def test_held_are_the_rows_of_postings_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, ["b", "a", None, "b"], "x y"), (2, None, None), (3, ["a"], "x y"), (4, [], "z")], "PageId long, Keywords array<string>, Title string")
    for fields in (("Keywords",), ("Title",), ("Keywords", "Title")):
        found = P.held(docs, fields)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        want = P.postings(docs, fields).select("field", "term", "PageId")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_the_dictionary_of_a_query_shuffles_counts_only(spark, monkeypatch):
    from ancestra.catalog import search
    from ancestra.operators.terms import Terms

    given = []
    monkeypatch.setattr(Terms, "write", lambda self, rows: given.append(rows) or self)
    search.dictionary(lambda name: spark.createDataFrame([(1, "one Two one", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars long"))
    assert "Exchange" not in given[0]._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.term for r in given[0].collect()) == ["one", "two"]


def test_files_of_a_write_are_ranges_that_are_found_without_making_all_rows_twice(spark, docs, tmp_path, monkeypatch):
    for name, value in (("SAMPLED", 50), ("FILE", 150), ("LEAST", 100)):
        monkeypatch.setattr(P, name, value)
    saved, save = [], P._save
    monkeypatch.setattr(P, "_save", lambda rows, path: saved.append(rows) or save(rows, path))
    for impact, order in ((None, ["field", "term", "PageId"]), ("Popularity", ["field", "term", "down", "PageId"])):
        path = str(tmp_path / str(impact))
        P.write(docs, path, ("Keywords", "Title"), impact=impact)
        assert "rangepartitioning" not in plan(saved[-1])
        found, want = P.read(spark, path), P.postings(docs, ("Keywords", "Title"), impact=impact)
        assert sorted(map(tuple, found.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
        named = found.selectExpr("*", "_metadata.file_name as file", *(["-impact as down"] if impact else []))
        files = {}
        for r in named.collect():
            files.setdefault(r.file, []).append(tuple(r[c] for c in order))
        spans = sorted((min(x), max(x)) for x in files.values())
        assert len(spans) > 5 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        assert len({f for f, x in files.items() if any(y[:2] == ("Keywords", "reed") for y in x)}) > 1  # a term of many documents is in several


def test_slices_hold_all_documents(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(P, "SLICE", 5)
    monkeypatch.setattr(P, "BATCH", 2)
    lists = [["b", "a", None, "b"], None, [], ["a"] * 9, ["c"], [], ["é", "z"], [None]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8, 0, -1)), pa.array(lists, pa.list_(pa.string()))], ["PageId", "t"])
    parts = list(P._slices(batch, 1))
    assert [k for p in parts for k in p.column(0).to_pylist()] == list(range(8, 0, -1)) and max(sum(len(x or ()) for x in p.column(1).to_pylist()) for p in parts) == 9
    rows = [tuple(r.values()) for p in parts for b in P._field_rows(p, "f", 1, False, (("f", "b", 9),), ["field", "term", "PageId", "positions", "part"]) for r in b.to_pylist()]
    want = {}
    for k, x in zip(range(8, 0, -1), lists):
        for i, w in enumerate(w for w in x or [] if w is not None):
            want.setdefault((w, k), []).append(i)
    assert sorted(rows) == sorted(("f", w, k, p, int((w, k) >= ("b", 9))) for (w, k), p in want.items())

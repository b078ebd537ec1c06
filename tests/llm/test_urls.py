import numpy as np

from ancestra.llm import urls
from ancestra.llm.queries import URL_RULES


def test_split():
    assert urls.split_url("HTTP://WWW.Ex.com/En/7?x=1#y") == ("www.ex.com", "/En/7")
    assert urls.split_url("http://h") == ("h", "") and urls.split_url("http://h?q") == ("h", "") and urls.split_url("http://h#f/a") == ("h", "")
    assert urls.split_url("no/scheme") == ("", "") and urls.split_url(None) == ("", "") and urls.split_url("a://b://c/d?e") == ("b:", "//c/d")


def test_rules():
    find = urls.Rules(URL_RULES).find
    cases = {
        ("a.example.com", "/en/8"): ("block", "com/en/"), ("example.com", "/en/71"): ("allow", "example.com/en/7"), ("x.net", "/de/"): ("allow", "net/de/"), ("m.example.net", "/de/8"): ("block", "example.net/de/8"),
        ("com", "/en/"): ("block", "com/en/"), ("notexample.com", "/en/7"): ("block", "com/en/"), ("a.org", "/es/1"): ("block", "org/es/"), ("a.com", "/en"): None, ("", ""): None, ("com.evil", "/en/"): None,
    }
    assert {k: find(*k) for k in cases} == cases
    assert urls.Rules([("allow", "net/")]).find("a.net", "/x") == ("allow", "net/") and urls.Rules([("allow", "net")]).find("net", "") == ("allow", "net")


def labelled(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        bad = rng.random() < 0.4
        host = "x" * int(rng.integers(3, 9)) + (".info" if bad and rng.random() < 0.8 else ".com")
        path = "/".join(["a"] * int(rng.integers(1, 3) + 3 * bad)) + f"/{rng.integers(10**5 if bad else 10)}"
        out.append((f"http://{host}/{path}" + ("?a=1&b=2&c=3" if bad and rng.random() < 0.5 else ""), bool(bad)))
    return out


def test_held_out_accuracy(spark):
    rows = list(dict(labelled()).items())
    train, test = rows[::2], rows[1::2]
    pages = spark.createDataFrame([(i, u, "x", 1.0) for i, (u, _) in enumerate(test)], "page_id long, url string, host string, score double")
    got = {r.page_id: r for r in urls.judge(pages, spark.createDataFrame(train, "url string, block boolean"), [("allow", "never/")]).collect()}
    right = np.mean([(got[i].verdict == "block") == y for i, (_, y) in enumerate(test)])
    assert right > 0.9
    assert urls.BoostedTrees().fit(np.zeros((0, 3)), np.zeros(0)).predict(np.zeros((2, 3))).tolist() == [0.5, 0.5]


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "x"), (None, "http://a.com/en/1"), (4, "http://A.org/es/"), (4, "http://A.org/es/"), (5, "http://h/" + "9" * 100_000), (6, "http://é.net/de/ü?q")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    none = spark.createDataFrame([], "url string, block boolean")
    got = [tuple(r) for r in urls.judge(pages, none, URL_RULES).collect()]
    assert len(got) == len(rows) and {g[5] for g in got} == {0.5}
    by = {g[0]: g[1:5] for g in got}
    assert by[1] == ("", "", None, "allow") and by[None] == ("a.com", "/en/1", "com/en/", "block") and by[4] == ("a.org", "/es/", "org/es/", "block") and by[6] == ("é.net", "/de/ü", "net/de/", "allow")
    one = spark.createDataFrame([("http://a/1", True), (None, True), ("http://a/1", False), ("b", None)], "url string, block boolean")
    assert urls.judge(pages, one, URL_RULES).count() == len(rows) and urls.judge(pages.limit(0), one, URL_RULES).count() == 0


def test_labels_of_documents(spark):
    pages = spark.createDataFrame([("http://h/en/12?x=5",), ("http://h/en/13/",), ("http://h/14.html#t",), ("http://h/",), (None,), ("http://h/99999999999999999999",)], "url string")
    labels = spark.createDataFrame([(12, 1, 0), (13, 0, 0), (14, 1, 1), (15, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, urls.labelled_by_document(pages, labels).collect())) == [("http://h/14.html#t", True), ("http://h/en/12?x=5", False), ("http://h/en/13/", True)]


def plain_judgement(url):
    """Host, path, rule and the rule's verdict, from the contract's words alone."""
    after = (url or "").split("://", 1)[1:]
    if not after:
        return "", "", None, None
    host = path = ""
    for i, c in enumerate(after[0]):
        if c in "/?#":
            path = after[0][i:]
            break
        host += c.lower() if "A" <= c <= "Z" else c
    for stop in "?#":
        path = path.split(stop, 1)[0]
    fitting = []
    for action, rule in URL_RULES:
        of, slash, start = rule.partition("/")
        if (host == of or host.endswith("." + of)) and path.startswith(slash + start):
            fitting.append((len(rule), action, rule))
    best = max(fitting, default=None)
    return host, path, best[2] if best else None, best[1] if best else None


def plain_score(model, row):
    """The trees' probability of one row, tree by tree."""
    binned, f = model._bins(np.array([row], dtype=float))[0], model.base
    for tree in model.model:
        f += model._apply(tree, binned[None, :])[0]
    return 1 / (1 + np.exp(-f))


def test_the_whole_query_equals_plain(spark):
    """Every page: the split and the rules from the contract, the rest from a model fitted apart on the same labels and asked one URL at a time."""
    from ancestra.llm.queries import op4_url_filter

    folder = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    some, y = urls.sample(urls.labelled_by_document(pages, spark.read.parquet(f"{folder}/labels.parquet")), urls.LABELLED)
    suffixes = urls.suffix_statistics(some, y)
    model = urls.BoostedTrees().fit(np.array([urls.lexical(u, suffixes) for u in some], dtype=float), y)
    given = pages.select("page_id", "url").collect()
    got = {r.page_id: r for r in op4_url_filter(spark, folder).collect()}
    assert len(got) == len(given)
    ruled = 0
    for r in given:
        host, path, rule, verdict = plain_judgement(r.url)
        g = got[r.page_id]
        assert (g.host, g.path, g.rule) == (host, path, rule)
        if verdict:
            ruled += 1
            assert g.verdict == verdict
        else:
            score = plain_score(model, urls.lexical(r.url, suffixes))
            assert abs(g.score - score) < 1e-12 and g.verdict == ("block" if score > 0.5 else "allow")
    assert 0 < ruled < len(given)

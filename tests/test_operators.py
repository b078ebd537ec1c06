"""Joins, labels, name variants, feeds and sources on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from ancestra.operators import nameservice as N
from ancestra.operators import relational as R
from ancestra.operators import sortkeys as K
from ancestra.sources import wiki as W
from ancestra.streaming import incremental as I


@pytest.mark.parametrize("how", ["backward", "forward", "forward_inclusive"])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_asof_against_brute_force(spark, how, by):
    rng = random.Random(4)
    left = [(i, rng.randrange(3), rng.choice([None, *range(40)])) for i in range(120)]
    right = [(rng.randrange(3), rng.randrange(40), i) for i in range(25)]
    l, r = spark.createDataFrame(left, "id int, g int, k int"), spark.createDataFrame(right, "g int, k int, v int")
    got = {x.id: x.found for x in R.asof(l, r if by else r.drop("g"), "k", "v", by=by, how=how).collect()}
    test = {"backward": lambda a, b: b <= a, "forward": lambda a, b: b > a, "forward_inclusive": lambda a, b: b >= a}[how]
    for i, g, k in left:
        near = [] if k is None else [(kk, v) for gg, kk, v in right if (not by or gg == g) and test(k, kk)]
        best = None
        if near:
            edge = (max if how == "backward" else min)(kk for kk, _ in near)
            best = min(v for kk, v in near if kk == edge)
        assert got[i] == best
    assert len(got) == len(left)


def test_keyed_merges(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    c = spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(R.upsert(t, c, "k")) == [(1, "a"), (2, "x"), (3, "y")]
    assert rows(R.delete_by_key(t, c, "k")) == [(1, "a")]
    assert rows(R.insert_ignore(t, c, "k")) == [(1, "a"), (2, "b"), (3, "y")]
    assert rows(R.update_from(t, c, "k", "v")) == [(1, "a"), (2, "x")]
    assert rows(R.insert_ignore(t.limit(0), c, "k")) == rows(c)


def test_labels(spark):
    keys = spark.createDataFrame([(k,) for k in ["b", "a", "p:x", "p:y", "z", "a"]], "k string")
    got = [r.k for r in K.rebuilt(keys, "k", "p:", 4).orderBy("value").collect()]
    assert got == sorted(set(got)) and len(got) == 5
    empty = spark.createDataFrame([], "sort_key string, value int")
    add = lambda labels, *ks: K.inserted(labels, spark.createDataFrame([(k,) for k in ks], "sort_key string"))
    one = add(empty, "m")
    assert one.first().value == 0
    two = add(one, "z")
    assert {r.sort_key: r.value for r in two.collect()} == {"m": 0, "z": 1073741823}
    three = add(two, "a", "m")
    assert {r.sort_key: r.value for r in three.collect()}["a"] == -1073741824


@pytest.mark.parametrize("labels, keys", [
    ([("a", 10), ("c", 11)], ["b"]), ([("a", 10), ("c", 11), ("d", 12), ("z", 900_000)], [f"b{i:04d}" for i in range(3000)] + ["e", "0"]),
    ([("a", -(1 << 31)), ("c", (1 << 31) - 1)], ["0", "b", "d"]), ([("a", 5), ("b", 6), ("m", 1000), ("n", 1001)], ["aa", "mm", "c", "o"]),
])
def test_full_gaps_are_widened(spark, labels, keys):
    out = K.inserted(spark.createDataFrame(labels, "sort_key string, value int"), spark.createDataFrame([(k,) for k in keys], "sort_key string"))
    got = sorted((r.sort_key, r.value) for r in out.collect())
    assert [k for k, _ in got] == sorted([*dict(labels), *keys]) and all(a[1] < b[1] for a, b in zip(got, got[1:], strict=False))
    if len(keys) > 100:
        assert dict(got)["z"] == 900_000  # far labels stay


def test_labels_stay_in_order(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abc", k=4)) for _ in range(40)]
    labels = spark.createDataFrame([], "sort_key string, value int")
    for part in (words[:15], words[15:]):
        made = K.inserted(labels, spark.createDataFrame([(w,) for w in part], "sort_key string"))
        labels = spark.createDataFrame(made.collect(), "sort_key string, value int")
    got = [r.sort_key for r in labels.orderBy("value").collect()]
    assert got == sorted(set(words))


def test_running_buckets_and_numbers(spark):
    df = spark.createDataFrame([(g, i, i % 4) for g in "ab" for i in range(20)], "g string, o int, w int")
    got = sorted(map(tuple, R.running_buckets(df, "g", "o", "w", 6).collect()))
    want = []
    for g in "ab":
        held = 0
        for i in range(20):
            held += i % 4
            if held >= 6:
                want.append((g, i, held))
                held = 0
    assert got == want
    n = R.numbered(df.where("g = 'a'"), "o", 100, 10).orderBy("o").collect()
    assert [r.label for r in n] == [100 + 10 * (i + 1) for i in range(20)]


@pytest.mark.parametrize("interval", [1, 5, 40])
def test_running_buckets_over_ranges(spark, interval):
    rng = random.Random(interval)
    rows = [(rng.choice(("a", "a", "a", "a", "b", "c", None)), i, rng.choice((0, 0, 1, 2, 3, 9, None))) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, o int, w int")
    for some in (df, df.where("g = 'a'"), df.where("false")):
        want, held = [], {}
        for g, o, w in sorted(some.collect(), key=lambda r: r.o):
            held[g] = held.get(g, 0) + (w or 0)
            if held[g] >= interval:
                want.append((g, o, held.pop(g)))
        assert sorted(map(tuple, R.running_buckets(some, "g", "o", "w", interval).collect()), key=lambda r: r[1]) == want
    with pytest.raises(Exception, match="at least 0"):
        R.running_buckets(spark.createDataFrame([("a", 1, -1)], df.schema), "g", "o", "w", 3).collect()


def test_one_group_is_folded_by_many_tasks(spark):
    df = spark.range(4000).selectExpr("1 as g", "id as o", "1 as w")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which takes so few rows together
    try:
        out = R.running_buckets(df, "g", "o", "w", 7)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.rdd.getNumPartitions() == 4 and [r.o for r in out.orderBy("o").collect()] == list(range(6, 4000, 7))


VARIANTS = [("smith", ["smyth"], ["smit", "smythe"]), ("smyth", ["smith"], [])]


def test_name_update(spark):
    v = spark.createDataFrame(VARIANTS, "name string, confirmed array<string>, computer array<string>")
    u = spark.createDataFrame([(n, n != "smitth") for n in ("smith", "smyth", "smit", "smitth", "schmidt", "jones")], "name string, common boolean")
    changed, log, rejected = N.update(v, u, "smith", ["jones", "smitth"], ["smit", "smyth"], "me", None, False, "20200101000000")
    rows = {r.name: (r.confirmed, r.computer) for r in changed.collect()}
    assert rejected == ["smitth"]
    assert rows["smith"] == (["jones", "smyth"], ["smythe"]) and rows["jones"] == (["smith"], []) and rows["smyth"] == ([], [])
    assert {(r.log_name, r.log_flags) for r in log.collect()} >= {("smith", 0), ("jones", 1), ("smitth", 1), ("smyth", 1)}
    assert N.update(v, u, "Smith!", [], [], "me", "", True, "0") is None
    admin = N.update(v, u, "smith", [], ["smyth"], "me", "", True, "0")[0].collect()
    assert {r.name: r.confirmed for r in admin}["smith"] == []


def test_name_info_and_synonyms(spark):
    v = spark.createDataFrame(VARIANTS, "name string, confirmed array<string>, computer array<string>")
    u = spark.createDataFrame([(n, True) for n in ("smith", "smyth", "smit", "schmidt")], "name string, common boolean")
    r = {x.name: x for x in N.info(spark.createDataFrame([("Smith",), ("van dyke",)], "name string"), v, u).collect()}
    assert r["Smith"].confirmed == ["smyth"] and r["Smith"].computer == ["smit", "smythe"] and r["Smith"].normalized == "smith"
    assert r["van dyke"].confirmed == [] and r["van dyke"].normalized == "van dyke"
    assert N.synonym_classes(["colony, a", "colony, b,", "x"]) == {"a": ["a", "b", "colony"], "b": ["a", "b", "colony"], "colony": ["a", "b", "colony"], "x": ["x"]}


def test_feeds(spark):
    d = W.delete_tasks(spark.createDataFrame([("2", 1, "Delete"), ("1", 2, "restore"), ("0", 3, "delete")], "timestamp string, page_id int, action string"), "1")
    assert sorted((r.page_id, r.action) for r in d.collect()) == [("1", 1), ("2", 0)]
    m = W.move_tasks(spark.createDataFrame([("1", 7, 8), ("2", 9, 0)], "timestamp string, source_id int, target_id int"))
    assert sorted((r.page_id, r.action) for r in m.collect()) == [("7", 1), ("8", 0), ("9", 1)]
    a = W.all_page_tasks(spark.createDataFrame([("5",), ("15",)], "page_id string"), "9")
    assert [r.page_id for r in a.collect()] == ["15"]
    assert [r.sequence_id for r in I.cursors(W.request_tasks(spark.createDataFrame([(9, 1), (10, 2)], "ir_id int, page_id int"))).collect()] == ["10"]


def test_incremental_equals_batch(spark):
    rng = random.Random(6)
    pages = spark.createDataFrame([(str(p), r, f"v{r}", p == 3) for r, p in enumerate([rng.randrange(6) for _ in range(40)], 1)], "page_id string, rev_id long, body string, is_redirect boolean")
    tasks = W.revision_tasks(pages.select("rev_id", "page_id", F.lit("x").alias("rev_timestamp")))
    tasks = tasks.unionByName(W.delete_tasks(spark.createDataFrame([("1", 4, "delete")], "timestamp string, page_id int, action string")))
    empty = pages.select("page_id", "rev_id", "body").limit(0)
    once = I.applied(empty, tasks, pages)
    half = I.applied(empty, tasks.where("rev_id <= 20 and rev_id > 0"), pages)
    twice = I.applied(half, tasks, pages)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(once) == rows(twice) and not {"3", "4"} & {r[0] for r in rows(once)}
    assert rows(I.applied(once, tasks, pages)) == rows(once)


def test_stream_replays(spark, tmp_path):
    pages = spark.createDataFrame([("1", 1, "a", False), ("2", 2, "b", False)], "page_id string, rev_id long, body string, is_redirect boolean")
    W.revision_tasks(pages.select("rev_id", "page_id", F.lit("x").alias("rev_timestamp"))).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(W.TASKS).parquet(str(tmp_path / "in"))
    for _ in range(2):
        I.run_stream(stream, pages, str(tmp_path / "index"), str(tmp_path / "progress"), ["page_id", "rev_id", "body"]).awaitTermination()
    got = I.latest_index(spark, str(tmp_path / "index"), ["page_id", "rev_id", "body"], pages)
    assert sorted(map(tuple, got.collect())) == [("1", 1, "a"), ("2", 2, "b")]


DUMP = """<mediawiki><page><title>A</title><id>1</id><revision><id>2</id><text>old</text></revision><revision><id>5</id><text>new</text></revision></page>
<page><title>B</title><id>2</id><revision><id>3</id><text>#REDIRECT [[A]]</text></revision></page></mediawiki>"""


def test_sources(spark, tmp_path):
    (tmp_path / "dump.xml").write_text(DUMP)
    assert [tuple(r) for r in W.read_dump(spark, str(tmp_path / "dump.xml")).collect()] == [("1", "A", 5, "new")]
    assert W.read_dump(spark, str(tmp_path / "dump.xml"), skip_redirects=False).count() == 2
    (tmp_path / "w.txt").write_text("# c\nb\n\na\n")
    assert sorted(r.word for r in W.read_words(spark, str(tmp_path / "w.txt")).collect()) == ["a", "b"]
    (tmp_path / "s.txt").write_text("S530: smith, smyth\n")
    assert W.read_sound_examples(spark, str(tmp_path / "s.txt")).first().examples == ["smith", "smyth"]
    (tmp_path / "p").write_text("# x\nmax_time = 9\nother=1\n")
    assert W.Config.read(str(tmp_path / "p")).max_time == 9
    xml = [("<add><doc><field name='PageId'>1</field><field name='T'>a</field><field name='T'>b</field></doc></add>",), ("<delete><id>2</id></delete>",), ("<bad",), (None,), ("<commit/>",)]
    got = sorted((r.action, r.page_id, (r.fields or {}).get("T")) for r in W.parse_update_xml(spark, spark.createDataFrame(xml, "xml string")).collect())
    assert got == [("add", "1", ["a", "b"]), ("commit", None, None), ("delete", "2", None)]
    path = W.write_versioned(spark.range(3).toDF("x"), str(tmp_path / "v"), "1")
    assert W.compacted(spark.read.parquet(path)).count() == 3


@pytest.mark.parametrize("parts", ["1", "7"])
def test_positions_in_large_groups_with_ties(spark, parts):
    rows = [(g, k) for g in ("a", "a", "a", None, "b") for k in range(40)] + [("a", 3)] * 30
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = R.positions(spark.createDataFrame(rows, "g string, k int"), ["k"], by=["g"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for g in ("a", None, "b"):
        mine = sorted((r.position, r.k) for r in got if r.g == g)
        assert [p for p, _ in mine] == list(range(1, len(mine) + 1)) and [k for _, k in mine] == sorted(k for _, k in mine)
    assert len(got) == len(rows)

"""Segments against the whole index after each batch."""

import random

import pytest
from pyspark.sql import functions as F

from ancestra.catalog import feeds
from ancestra.operators import postings as P
from ancestra.operators import search as S
from ancestra.operators import segments as G
from ancestra.plans.ast import Options
from ancestra.streaming import incremental as I

WORDS = ["reed", "una", "smith", "ohio"]
SCHEMA = "page_id string, rev_id long, words array<string>"


def rows_of(df):
    return sorted((r.page_id, r.rev_id, *(r.words or [])) for r in df.collect())


@pytest.mark.parametrize("fields", [(), ("words",)])
def test_batches_equal_the_whole(spark, tmp_path, fields):
    r = random.Random(4)
    some = lambda: r.choices(WORDS, k=r.randrange(4))
    want = {str(i): (str(i), 1, some()) for i in range(60)}
    seg = G.Segments(spark, f"file://{tmp_path}/s", fields=fields, fan=3, least=4, counted=("words", "rev_id"))
    seg.create(spark.createDataFrame(list(want.values()), SCHEMA))
    with pytest.raises(ValueError):
        seg.create(spark.createDataFrame([], SCHEMA))
    for batch in range(7):
        changed = {str(k): (str(k), batch + 2, some()) for k in r.sample(range(80), 5)}
        gone = [str(k) for k in r.sample(range(80), 4)]
        want = {k: v for k, v in want.items() if k not in gone} | changed
        changes, lost = spark.createDataFrame(list(changed.values()), SCHEMA), spark.createDataFrame([(g,) for g in gone], "page_id string")
        assert seg.apply(batch, changes, lost) and not seg.apply(batch, changes.limit(0), lost.limit(0))
    assert rows_of(seg.index()) == sorted((a, b, *w) for a, b, w in want.values())
    for f in ("words", "rev_id"):  # kept current, also over merges
        recounted = {str(r.value): r["count"] for r in S.facet(seg.index(), f).collect()}
        assert {r.value: r["count"] for r in seg.counts(f).collect()} == recounted
    m = seg.manifest()
    assert m["batch"] == 6 and len(m["segments"]) <= 6
    assert {s["name"] for s in m["segments"]} <= set(seg.store.names("segment-")) and len(seg.store.names("manifest-")) == G.KEPT
    if fields:
        docs, table = seg.index(), seg.postings()
        assert P.written_fields(table) == ("words",)
        for q in ("words:reed", "+words:una -words:smith", 'words:"reed una"'):
            one, two = (sorted(r.page_id for r in S.search(docs, q, Options(exact=True), rows=99, key="page_id", postings=p).docs.collect()) for p in (None, table))
            assert one == two
    seg.optimize()
    assert rows_of(seg.index()) == sorted((a, b, *w) for a, b, w in want.values())
    assert sum(r["count"] for r in seg.counts("rev_id").collect()) == len(want)
    only = seg.manifest()["segments"]
    assert len(only) == 1 and only[0]["rows"] == len(want)
    if fields:
        assert sorted((x.term, x.page_id) for x in seg.postings().collect()) == sorted((x.term, x.page_id) for x in P.postings(seg.index(), fields, "page_id").collect())


def test_written_in_proportion_to_the_changes(spark, tmp_path):
    seg = G.Segments(spark, str(tmp_path / "s"))
    seg.create(spark.range(50_000).selectExpr("cast(id as string) page_id", "1L rev_id", "array(sha2(cast(id as string), 256)) words"))
    base = seg.manifest()["segments"][0]
    written = 0
    for batch in range(3):
        seg.apply(batch, spark.createDataFrame([("7", batch + 2, ["x"])], SCHEMA), spark.createDataFrame([(str(batch),)], "page_id string"))
        written += seg.manifest()["segments"][-1]["bytes"]
    assert seg.manifest()["segments"][0] == base and written < base["bytes"] / 50
    assert seg.index().count() == 50_000 - 3 and seg.index().where("page_id = '7'").first().rev_id == 4


def test_a_batch_that_was_not_committed_leaves_nothing(spark, tmp_path, monkeypatch):
    seg = G.Segments(spark, str(tmp_path / "s"))
    seg.create(spark.createDataFrame([("1", 1, ["a"])], SCHEMA))
    change, none = spark.createDataFrame([("1", 2, ["b"])], SCHEMA), spark.createDataFrame([], "page_id string")
    with monkeypatch.context() as broken:
        broken.setattr(type(seg.store), "write", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            seg.apply(0, change, none)
    assert rows_of(seg.index()) == [("1", 1, "a")]
    assert seg.apply(0, change, none) and rows_of(seg.index()) == [("1", 2, "b")]


def test_stream_of_tasks_equals_one_shot_and_replays_change_nothing(spark, tmp_path):
    pages = spark.createDataFrame([(str(i), 10 + i, ["p"], i % 5 == 0) for i in range(20)], SCHEMA + ", is_redirect boolean")
    index = spark.createDataFrame([(str(i), 5, ["old"]) for i in range(0, 30, 3)], SCHEMA)
    tasks = [("revisions", str(i), str(i), 0, 10 + i, "t") for i in range(20)] + [("deletes", f"9{i}", str(i), 1, 0, "t") for i in (3, 4, 27)]
    for i in range(4):
        spark.createDataFrame([x for j, x in enumerate(tasks) if j // 6 == i], "feed string, sequence_id string, page_id string, action int, rev_id long, rev_timestamp string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    every = spark.read.parquet(str(tmp_path / "in"))
    seg = G.Segments(spark, str(tmp_path / "s"), fan=2)
    seg.create(index)
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for checkpoint in ("a", "a", "b"):  # at the end, gone on with, and all once more from the beginning
        G.run_stream(stream, pages, seg, str(tmp_path / checkpoint)).awaitTermination()
        assert rows_of(seg.index()) == rows_of(I.applied(index, every, pages).select("page_id", "rev_id", "words"))
        assert seg.manifest()["batch"] == 3
    assert seg.index().where(F.col("page_id").isin("3", "4", "27")).count() == 0


def test_the_tasks_of_a_batch_are_made_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    page = F.udf(lambda i: seen.add(1) or str(i), "string").asNondeterministic()
    tasks = spark.range(100).select(F.lit("revisions").alias("feed"), F.col("id").cast("string").alias("sequence_id"), page("id").alias("page_id"), F.lit(0).alias("action"), (F.col("id") + 1).alias("rev_id"), F.lit("t").alias("rev_timestamp"))
    pages = spark.range(100).selectExpr("cast(id as string) page_id", "id + 1 rev_id", "array('a') words", "id % 7 = 3 is_redirect")
    seg = G.Segments(spark, str(tmp_path / "s"))
    seg.create(pages.drop("is_redirect").limit(0))
    assert G.apply_tasks(seg, 0, tasks, pages) and seg.index().count() == 86
    assert seen.value == 100


@pytest.mark.parametrize("name", ["segmented_apply_feed", "maintained_counts"])
def test_batches_of_a_query_look_pages_up_among_one_row_a_page(spark, monkeypatch, name):
    events = spark.range(300).selectExpr("id event_id", "timestamp_seconds(id) ts", "id % 20 user_id", "'click' event_type")
    given = []
    monkeypatch.setattr(feeds, "apply_tasks", lambda segments, batch, tasks, pages: given.append(pages))
    getattr(feeds, name)(lambda table: events)
    assert given and all(p is given[0] for p in given)
    assert sorted((int(r.page_id), r.rev_id, r.body, r.is_redirect) for r in given[0].collect()) == [(i, 280 + i, "click", i % 7 == 3) for i in range(20)]

"""Feeds as a data source, and the guard that keeps state."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ancestra.sources import feeds
from ancestra.streaming import stateful

TASKS = "feed string, sequence_id string, page_id string, action int, rev_id long, rev_timestamp string"


class Listed(feeds.Transport):
    """Rows that the test itself has."""

    def __init__(self, rows):
        self.all = rows

    def latest(self, feed):
        rows = self.all.get(feed)
        return feeds.cursor_of(feed, rows[-1]) if rows else None

    def cuts(self, feed, after, until):
        return [*(feeds.cursor_of(feed, r) for r in self.all[feed][1::2] if feeds.place(feed, after) < feeds.place(feed, feeds.cursor_of(feed, r)) < feeds.place(feed, until)), until]

    def rows(self, feed, after, until):
        return (r for r in self.all[feed] if feeds.beyond(feed, r, after) and feeds.place(feed, feeds.cursor_of(feed, r)) <= feeds.place(feed, until))


LOG = [("05", 3, "delete"), ("07", 1, "delete"), ("07", 2, "restore"), ("07", 9, "delete"), ("07", 10, "delete"), ("11", 1, "restore")]


def read(spark, transport, feed, **options):
    spark.dataSource.register(feeds.feed_source(transport))
    return [tuple(r) for r in feeds.read_feed(spark, feed, **options).collect()]


def test_cursors(spark):
    t = Listed({"deletes": LOG, "revisions": [(i, i % 3, None) for i in (2, 9, 10, 100)], "all": [], "moves": [("05", 1, 2), ("05", 4, 0), ("06", 2, 3)]})
    assert sorted(read(spark, t, "deletes")) == sorted(LOG)
    assert sorted(read(spark, t, "deletes", after="07/9")) == sorted(LOG[1:])  # all of the cursor's timestamp once more
    assert sorted(read(spark, t, "deletes", after="07/9", until="07/10")) == sorted(LOG[1:5])
    assert read(spark, t, "deletes", after="11/1") == []  # nothing is new
    assert [r[0] for r in sorted(read(spark, t, "revisions", after="9"))] == [10, 100]
    assert read(spark, t, "all") == [] and sorted(read(spark, t, "moves", after="05/1")) == [("05", 4, 0), ("06", 2, 3)]
    with pytest.raises(Exception, match="feed must be one of"):
        read(spark, t, "nothing")


@pytest.mark.parametrize("size", [1, 2, 100])
def test_pages_give_what_was_written(spark, tmp_path, size):
    path = f"file://{tmp_path}/p"
    rows = spark.createDataFrame(LOG, feeds.COLUMNS["deletes"])
    feeds.write_pages(rows.where("timestamp < '07'"), path, "deletes", size)
    feeds.write_pages(rows.where("timestamp >= '07'"), path, "deletes", size)
    t = feeds.Pages(path)
    assert sorted(read(spark, t, "deletes")) == sorted(LOG)
    assert sorted(read(spark, t, "deletes", after="07/2")) == sorted(LOG[1:])
    assert read(spark, t, "moves") == []


def test_many_pages_take_few_folders_and_tasks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "p")
    rows = spark.range(1, 1501).selectExpr("id as rev_id", "id % 7 as page_id", "cast(null as string) as rev_timestamp")
    feeds.write_pages(rows.repartition(3), path, "revisions", 2)
    assert len(list((tmp_path / "p" / "revisions").glob("upto=*"))) == 1
    (file,) = (tmp_path / "p" / "revisions").glob("upto=*/*.parquet")
    groups = pq.ParquetFile(file).metadata
    assert [groups.row_group(i).num_rows for i in range(groups.num_row_groups)] == [2] * 750
    spark.dataSource.register(feeds.feed_source(feeds.Pages(path)))
    read = feeds.read_feed(spark, "revisions", "7")
    assert read.rdd.getNumPartitions() == 1 and sorted(r.rev_id for r in read.collect()) == list(range(8, 1501))
    monkeypatch.setattr(feeds, "ROWS_A_FILE", 100)
    monkeypatch.setattr(feeds, "MOST_SPANS", 4)
    feeds.write_pages(rows.withColumn("rev_id", F.col("rev_id") + 1500), path, "revisions", 30)  # 17 folders of 90 rows
    read = feeds.read_feed(spark, "revisions", "7")
    assert len(list((tmp_path / "p" / "revisions").glob("upto=*"))) == 18
    assert len(feeds.Pages(path).cuts("revisions", "7", "3000")) <= 5 and sorted(r.rev_id for r in read.collect()) == list(range(8, 3001))


def test_a_stream_goes_on_without_loss(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.dataSource.register(feeds.feed_source(feeds.Pages(path)))
    rows = spark.range(1, 40).selectExpr("id as rev_id", "id % 7 as page_id", "cast(null as string) as rev_timestamp")
    for upto in (0, 13, 14, 39):
        if upto:
            done = {13: 0, 14: 13, 39: 14}[upto]
            feeds.write_pages(rows.where((F.col("rev_id") > done) & (F.col("rev_id") <= upto)), path, "revisions", 5)
        stream = feeds.page_tasks(spark.readStream.format("wikifeed").option("feed", "revisions").load(), "revisions")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        if upto:
            assert sorted(r.rev_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(1, upto + 1))


def test_guard_keeps_state_over_a_restart(spark, tmp_path):
    tasks = [
        [("a", 0, 5), ("a", 0, 7), ("b", 0, 3), ("c", 0, 1)],
        [("a", 0, 7), ("a", 0, 6), ("a", 0, 8), ("b", 1, 0), ("c", 0, 0), ("d", 0, 2)],
        [("a", 0, 8), ("b", 0, 2), ("d", 0, 3)],
    ]
    passed = []
    for i, some in enumerate(tasks):
        spark.createDataFrame([("revisions", str(i), p, a, r, "t") for p, a, r in some], TASKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stateful.guarded_stream(spark.readStream.schema(TASKS).parquet(str(tmp_path / "in")), spark.createDataFrame([("c", 1), ("d", 2)], "page_id string, rev_id long"))
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        every = sorted((r.page_id, r.action, r.rev_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        new = list(every)
        for x in passed:
            new.remove(x)
        passed = every
        assert new == [[("a", 0, 5), ("a", 0, 7), ("b", 0, 3)], [("a", 0, 8), ("b", 1, 0), ("c", 0, 0)], [("b", 0, 2), ("d", 0, 3)]][i]

"""Queries of change feeds and incremental indexing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ancestra.operators.segments import Segments, apply_tasks
from ancestra.session import shared_dir
from ancestra.sources import wiki as W
from ancestra.sources.feeds import Pages, feed_source, page_tasks, read_feed, write_pages
from ancestra.streaming import incremental as I
from ancestra.streaming.stateful import guarded_stream

from . import query


def revisions(t):
    """Events as a revision feed: event_id the revision, user_id the page."""
    return W.revision_tasks(t("events").select(F.col("event_id").alias("rev_id"), F.col("user_id").alias("page_id"), F.date_format("ts", "yyyyMMddHHmmss").alias("rev_timestamp")))


@query("SELECT user_id::varchar AS page_id, max(event_id)::bigint AS rev_id FROM events WHERE event_id > 0 GROUP BY 1")
def task_dedupe(t):
    return I.deduplicated(revisions(t)).select("page_id", "rev_id")


@query("WITH i AS (SELECT user_id, max(event_id) AS r FROM events WHERE event_id <= 500 GROUP BY 1) SELECT event_id::bigint AS rev_id FROM events e WHERE event_id > 0 AND NOT EXISTS (SELECT 1 FROM i WHERE i.user_id = e.user_id AND i.r >= e.event_id)")
def revision_guard(t):
    indexed = t("events").where("event_id <= 500").groupBy(F.col("user_id").cast("string").alias("page_id")).agg(F.max("event_id").alias("rev_id"))
    return I.guarded(revisions(t), indexed).select("rev_id")


@query("SELECT event_id::bigint AS id, CASE WHEN lower(event_type) = 'click' THEN 1 ELSE 0 END::int AS action FROM events")
def undelete_action(t):
    log = t("events").select(F.lpad(F.col("event_id").cast("string"), 14, "0").alias("timestamp"), F.col("user_id").alias("page_id"), F.when(F.col("event_type") == "click", "Delete").otherwise("restore").alias("action"))
    d = W.delete_tasks(log)
    return d.select(F.substring_index("sequence_id", "/", 1).cast("long").alias("id"), "action")


@query("SELECT user_id::varchar AS page_id, 1::int AS action, event_id::bigint AS id FROM events WHERE user_id <> 0 UNION ALL SELECT (event_id % 3)::varchar, 0, event_id FROM events WHERE event_id % 3 <> 0")
def move_explode(t):
    log = t("events").select(F.lpad(F.col("event_id").cast("string"), 14, "0").alias("timestamp"), F.col("user_id").alias("source_id"), (F.col("event_id") % 3).alias("target_id"))
    return W.move_tasks(log).select("page_id", "action", F.substring_index("sequence_id", "/", 1).cast("long").alias("id"))


PAGES = "SELECT user_id::varchar AS page_id, max(event_id)::bigint AS rev_id, max_by(event_type, event_id) AS body FROM events {} GROUP BY 1"


def pages(t):
    return t("events").select(F.col("user_id").cast("string").alias("page_id"), F.col("event_id").alias("rev_id"), F.col("event_type").alias("body"), (F.col("user_id") % 7 == 3).alias("is_redirect"))


def stored_pages(t, root):
    """The highest revision of each page, made once for all batches."""
    rows = pages(t)
    I.newest(rows).write.parquet(f"{root}/pages")
    return rows.sparkSession.read.parquet(f"{root}/pages")


def start(t):
    return t("events").where("event_id <= 500 and user_id % 7 <> 3").groupBy(F.col("user_id").cast("string").alias("page_id")).agg(F.max("event_id").alias("rev_id"), F.max_by("event_type", "event_id").alias("body"))


def feed(t):
    """Updates of all pages, and deletes of each fifth."""
    gone = t("events").where("user_id % 5 = 0").select(F.lit("20200101000000").alias("timestamp"), F.col("user_id").alias("page_id"), F.lit("delete").alias("action")).distinct()
    return revisions(t).unionByName(W.delete_tasks(gone))


APPLIED = "SELECT user_id::varchar AS page_id, max(event_id)::bigint AS rev_id, max_by(event_type, event_id) AS body FROM events WHERE user_id % 5 <> 0 AND user_id % 7 <> 3 GROUP BY 1"


@query(APPLIED)
def apply_feed(t):
    """A batch of updates and deletes applied to an index; redirects leave it."""
    return I.applied(start(t), feed(t), pages(t))


@query("SELECT 'revisions' AS feed, max(event_id)::varchar AS sequence_id FROM events")
def feed_cursors(t):
    return I.cursors(revisions(t))


@query("SELECT event_id::varchar AS sequence_id, ((row_number() OVER (ORDER BY event_id) - 1) // 50)::int AS batch FROM events WHERE event_id > 0")
def task_batches(t):
    return I.batches(revisions(t), 50).select("sequence_id", "batch")


def scratch(spark, name):
    """A new folder of the shared store."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(APPLIED)
def streaming_apply_feed(t):
    """The same feed as a stream of files, applied to versions of the index; the last version is the result."""
    tasks = feed(t)
    spark = tasks.sparkSession
    root = scratch(spark, "feed")
    tasks.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(tasks.schema).parquet(f"{root}/in")
    start(t).write.parquet(f"{root}/index/version=-1")
    run = I.run_stream(stream, pages(t), f"{root}/index", f"{root}/progress", ["page_id", "rev_id", "body"])
    run.awaitTermination()
    return I.latest_index(spark, f"{root}/index", ["page_id", "rev_id", "body"], pages(t))


@query("SELECT page, (SELECT max(c)::varchar FROM (SELECT c_custkey AS c FROM customer WHERE c_custkey > 5 ORDER BY 1 LIMIT 40)) AS sequence_id, FALSE AS at_end FROM (VALUES (5)) v(page) UNION ALL SELECT m, '0', FALSE FROM (SELECT (max(c_custkey) - 7)::int AS m FROM customer) UNION ALL SELECT m, (m + 7)::varchar, TRUE FROM (SELECT (max(c_custkey) - 7)::int AS m FROM customer)")
def all_pages_cursor(t):
    """Pages of 40 of the feed of all pages: a full one, one that rolls over, and one at the end."""
    pages = t("customer").select(F.col("c_custkey").alias("page_id"))
    end = pages.agg(F.max("page_id")).first()[0] - 7
    out = None
    for after, roll_over in ((5, False), (end, True), (end, False)):
        c = W.all_pages_cursor(W.all_page_tasks(pages, str(after), 40), str(after), 40, roll_over)
        c = c.select(F.lit(int(after)).alias("page"), "sequence_id", "at_end")
        out = c if out is None else out.unionByName(c)
    return out


@query(APPLIED)
def segmented_apply_feed(t):
    """The same feed in ten batches, each of which adds a segment; segments are merged as they become many, and the last batch comes twice."""
    tasks = feed(t)
    root = scratch(tasks.sparkSession, "segments")
    segments, current = Segments(tasks.sparkSession, f"{root}/index"), stored_pages(t, root)
    segments.create(start(t))
    part = F.when(F.col("feed") == "deletes", 9).otherwise(F.col("rev_id") % 9)
    for i in (*range(10), 9):
        apply_tasks(segments, i, tasks.where(part == i), current)
    return segments.index()


def feed_rows(t, feed):
    """Events as the rows of a feed."""
    e, stamp = t("events"), F.lpad((F.col("event_id") / 3).cast("long").cast("string"), 14, "0")  # three log rows a timestamp
    if feed == "revisions":
        return e.select(F.col("event_id").alias("rev_id"), F.col("user_id").cast("long").alias("page_id"), F.date_format("ts", "yyyyMMddHHmmss").alias("rev_timestamp"))
    return e.select(stamp.alias("timestamp"), F.col("event_id").alias("page_id"), F.when(F.col("event_type") == "click", "Delete").otherwise("restore").alias("action"))


def feed_source_of(spark, path):
    spark.dataSource.register(feed_source(Pages(path)))
    return path


@query("SELECT event_id::varchar AS sequence_id, user_id::varchar AS page_id, event_id::bigint AS rev_id, strftime(ts, '%Y%m%d%H%M%S') AS rev_timestamp FROM events WHERE event_id > 100")
def feed_source_batch(t):
    """Revisions after a cursor, read through the data source from pages of 300 rows, as tasks."""
    rows = feed_rows(t, "revisions")
    path = feed_source_of(rows.sparkSession, scratch(rows.sparkSession, "pages"))
    write_pages(rows, path, "revisions", 300)
    return page_tasks(read_feed(rows.sparkSession, "revisions", "100"), "revisions").select("sequence_id", "page_id", "rev_id", "rev_timestamp")


@query("SELECT lpad((event_id // 3)::varchar, 14, '0') || '/' || event_id::varchar AS sequence_id, event_id::varchar AS page_id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END::int AS action FROM events WHERE event_id // 3 >= 20")
def feed_source_deletes(t):
    """The delete log from a cursor within a timestamp, whose rows are all read again."""
    rows = feed_rows(t, "deletes")
    path = feed_source_of(rows.sparkSession, scratch(rows.sparkSession, "pages"))
    write_pages(rows, path, "deletes", 300)
    return page_tasks(read_feed(rows.sparkSession, "deletes", "00000000000020/61"), "deletes").select("sequence_id", "page_id", "action")


@query("SELECT event_id::varchar AS sequence_id, user_id::varchar AS page_id FROM events WHERE event_id > 0")
def feed_source_stream(t):
    """Revisions as a stream that is stopped, and goes on from its checkpoint once the rest of the pages is there."""
    rows = feed_rows(t, "revisions")
    spark = rows.sparkSession
    path = feed_source_of(spark, scratch(spark, "pages"))
    half = F.col("rev_id") <= rows_middle(rows)
    for part in (half, ~half):
        write_pages(rows.where(part), path, "revisions", 300)
        stream = page_tasks(spark.readStream.format("wikifeed").option("feed", "revisions").load(), "revisions")
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("sequence_id", "page_id")


@query("WITH i AS (SELECT user_id, max(event_id) AS r FROM events WHERE event_id <= 500 GROUP BY 1) SELECT event_id::bigint AS rev_id FROM events e WHERE event_id > 0 AND NOT EXISTS (SELECT 1 FROM i WHERE i.user_id = e.user_id AND i.r >= e.event_id)")
def stateful_revision_guard(t):
    """The guard as a stream that keeps each page's revision as state, begun with those indexed; half of the events, a restart, and the rest with some of the first half again."""
    tasks = revisions(t)
    spark = tasks.sparkSession
    path = scratch(spark, "guard")
    indexed = t("events").where("event_id <= 500").groupBy(F.col("user_id").cast("string").alias("page_id")).agg(F.max("event_id").alias("rev_id"))
    middle = rows_middle(tasks)
    for part in (F.col("rev_id") <= middle, F.col("rev_id") > middle - 50):
        tasks.where(part).write.mode("append").parquet(f"{path}/in")
        passed = guarded_stream(spark.readStream.schema(tasks.schema).parquet(f"{path}/in"), indexed).select("rev_id")
        passed.writeStream.format("parquet").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.parquet(f"{path}/out")


def rows_middle(tasks):
    return tasks.agg(F.expr("percentile_approx(rev_id, 0.5)")).first()[0]


@query(f"SELECT body AS value, count(*) AS count FROM ({APPLIED}) GROUP BY 1")
def maintained_counts(t):
    """Facet counts kept current from the old and new rows of each batch, not counted again."""
    tasks = feed(t)
    root = scratch(tasks.sparkSession, "segments")
    segments, current = Segments(tasks.sparkSession, f"{root}/index", counted=("body",)), stored_pages(t, root)
    segments.create(start(t))
    for i in range(3):
        apply_tasks(segments, i, tasks.where(F.when(F.col("feed") == "deletes", 2).otherwise(F.col("rev_id") % 2) == i), current)
    return segments.counts("body")

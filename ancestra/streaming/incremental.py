"""Keeping an index current from change feeds, in batches or as a stream."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ancestra.operators.relational import positions
from ancestra.sources.wiki import DELETE

#: Feeds in the order in which they are applied.
FEEDS = ("moves", "requests", "revisions", "deletes", "all")


def feed_rank(column: str = "feed"):
    return F.array_position(F.array(*[F.lit(f) for f in FEEDS]), F.col(column))


def deduplicated(tasks: DataFrame) -> DataFrame:
    """The last task of each page: by feed order, and in a feed by revision and sequence."""
    order = F.struct(feed_rank().alias("f"), F.col("rev_id").alias("r"), F.lpad(F.col("sequence_id"), 32, "0").alias("s"))
    last = tasks.groupBy("page_id").agg(F.max_by(F.struct("feed", "sequence_id", "action", "rev_id", "rev_timestamp"), order).alias("t"))
    return last.select("t.feed", "t.sequence_id", "page_id", "t.action", "t.rev_id", "t.rev_timestamp")


def guarded(tasks: DataFrame, indexed: DataFrame) -> DataFrame:
    """Tasks without updates of a revision that isn't newer than the one indexed (page_id, rev_id)."""
    seen = indexed.select(F.col("page_id").alias("__p"), F.col("rev_id").alias("__r"))
    old = (F.col("page_id") == F.col("__p")) & (F.col("rev_id") > 0) & (F.col("__r") >= F.col("rev_id")) & (F.col("action") != DELETE)
    return tasks.join(seen, old, "left_anti")


def newest(pages: DataFrame) -> DataFrame:
    """The highest revision of each page."""
    return pages.groupBy("page_id").agg(F.max_by(F.struct(*[c for c in pages.columns if c != "page_id"]), "rev_id").alias("p")).select("page_id", "p.*")


def applied(index: DataFrame, tasks: DataFrame, pages: DataFrame) -> DataFrame:
    """The index after a batch of tasks: keyed by page_id, idempotent.

    Deleted pages, and pages that are now redirects or are gone, leave; updated ones are taken from
    `pages`, which has the index's columns and `is_redirect`. Of repeated pages the highest revision counts.
    """
    todo = guarded(deduplicated(tasks), index.select("page_id", "rev_id"))
    fresh = newest(pages).join(todo.where(F.col("action") != DELETE).select(F.col("page_id").alias("__p")), F.col("page_id") == F.col("__p"), "left_semi").where("not is_redirect")
    return index.join(todo.select(F.col("page_id").alias("__p")), F.col("page_id") == F.col("__p"), "left_anti").unionByName(fresh.select(*index.columns))


def cursors(tasks: DataFrame) -> DataFrame:
    """(feed, sequence_id): where each feed goes on after these tasks; saved once their batch is."""
    return tasks.groupBy("feed").agg(F.max_by("sequence_id", F.lpad("sequence_id", 32, "0")).alias("sequence_id"))


def within_budget(tasks: DataFrame, most: int) -> DataFrame:
    """The first `most` tasks in feed order: what a run of bounded time takes; the rest waits for the next."""
    return tasks.orderBy(feed_rank(), F.lpad("sequence_id", 32, "0"), "page_id", "action").limit(most)


def batches(tasks: DataFrame, size: int) -> DataFrame:
    """tasks with the number of their batch, `size` a batch, within each feed."""
    ordered = tasks.withColumn("__s", F.lpad(F.col("sequence_id"), 32, "0"))
    return positions(ordered, ["__s", "page_id"], by=["feed"], out="__n").withColumn("batch", ((F.col("__n") - 1) / size).cast("int")).drop("__s", "__n")


def run_stream(tasks: DataFrame, pages: DataFrame, root: str, checkpoint: str, columns: list[str]) -> StreamingQuery:
    """Apply a stream of tasks to the index kept as versions below `root`, all that is available, then stop.

    Each micro-batch reads the last version, applies its tasks and writes the next; a repeated
    micro-batch writes its own version anew, so replays change nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        index = latest_index(batch.sparkSession, root, columns, pages, number)
        applied(index, batch, pages).write.mode("overwrite").parquet(f"{root}/version={number:012d}")

    return tasks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finish_within(stream: StreamingQuery, seconds: float, poll: float = 0.2) -> bool:
    """Let a stream run for a time budget; whether it came to its end.

    It is stopped between micro-batches once another one as long as the longest so far would
    outlast the budget, and at the budget's end in any case. What a stopped batch has not written is done by the next run.
    """
    stop, seen = time.monotonic() + seconds, -1
    while not stream.awaitTermination(poll):
        done = stream.recentProgress
        longest = max((p["durationMs"].get("triggerExecution", 0) for p in done), default=0) / 1000
        number = done[-1]["batchId"] if done else -1
        left = stop - time.monotonic()
        if left <= 0 or (number > seen and left < longest):
            stream.stop()
            return False
        seen = number
    return True


def versions(spark, root: str) -> list[str]:
    """Version folders below `root`, in order; listed through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(path) if s.getPath().getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))


def latest_index(spark, root: str, columns: list[str], pages: DataFrame, before: int | None = None) -> DataFrame:
    """The last whole version (before a number), or an empty index."""
    known = [v for v in versions(spark, root) if before is None or int(v.rpartition("=")[2]) < before]
    return spark.read.parquet(known[-1]).select(*columns) if known else pages.select(*columns).limit(0)

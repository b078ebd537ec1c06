"""The revision guard with a state of its own: each page's highest revision, kept between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ancestra.sources.wiki import DELETE

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state(spark: SparkSession) -> None:
    """State lies in RocksDB on the executors' disks, with its changes in the checkpoint; what follows needs that store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Revisions(StatefulProcessor):
    """Lets a page's task pass unless it updates to a revision that isn't newer than those of earlier micro-batches.

    A delete passes and forgets the page. Tasks without a revision pass. State that wasn't touched for
    `ttl` milliseconds expires, if that is given.
    """

    def __init__(self, ttl: int | None = None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "rev_id long", self.ttl)

    def _before(self) -> int:
        seen = self.seen.get()  # none if there is no state: one call of the store, not two
        return int(seen[0]) if seen is not None else 0

    def handleInputRows(self, key, rows, timers) -> Iterator:
        before = self._before()
        newest, deleted = before, False
        for frame in rows:  # a page's tasks of a micro-batch in several frames, none of which must be held
            revision, gone = frame["rev_id"].to_numpy(), frame["action"].to_numpy() == DELETE  # most pages have few tasks, for which operations of pandas cost the most
            passed = gone | (revision <= 0) | (revision > before)
            deleted |= bool(gone.any())
            newest = max(newest, int(revision[passed & ~gone].max(initial=0)))
            if passed.all():
                yield frame
            elif passed.any():
                yield frame[passed]
        if deleted:
            self.seen.clear()
        elif newest > 0:
            self.seen.update((newest,))

    def handleInitialState(self, key, initial, timers) -> None:
        self.seen.update((int(initial["rev_id"].max()),))

    def close(self) -> None:
        pass


def guarded_stream(tasks: DataFrame, indexed: DataFrame | None = None, ttl: int | None = None) -> DataFrame:
    """A stream of tasks without updates of revisions that aren't newer than what was seen; `indexed` (page_id, rev_id) is where the state begins."""
    keep_state(tasks.sparkSession)
    start = indexed.select("page_id", F.col("rev_id").cast("long").alias("rev_id")).groupBy("page_id") if indexed is not None else None
    return tasks.groupBy("page_id").transformWithStateInPandas(Revisions(ttl), tasks.schema, "append", "ProcessingTime" if ttl else "None", start)

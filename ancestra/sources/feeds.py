"""Change feeds as a data source of Spark, for batches and streams.

    spark.dataSource.register(feed_source(transport))
    spark.read.format("wikifeed").option("feed", "revisions").option("after", 17).load()
    spark.readStream.format("wikifeed").option("feed", "moves").load()

A transport, given by the caller, knows how to get a feed's rows; page_tasks() makes index tasks
of them. Offsets are cursors: an id, or timestamp/page of the logs. A stream's offset is
the cursor up to which rows were read, so a query that goes on from its checkpoint loses none; the
delete log reads the rows of its cursor's timestamp again, as several may have it.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ancestra.operators.relational import positions
from ancestra.sources import wiki as W
from ancestra.sources.store import filesystem

#: Columns of each feed's rows; the first, or the first two with a slash between, are its cursor.
COLUMNS = {
    "requests": "ir_id long, page_id long",
    "revisions": "rev_id long, page_id long, rev_timestamp string",
    "deletes": "timestamp string, page_id long, action string",
    "moves": "timestamp string, source_id long, target_id long",
    "all": "page_id long, namespace int",
}
LOGS = ("deletes", "moves")


def place(feed: str, cursor: str) -> tuple:
    """A cursor as what it is ordered by."""
    stamp, _, page = cursor.partition("/")
    return (stamp, int(page or 0)) if feed in LOGS else (int(stamp or 0),)


def cursor_of(feed: str, row: tuple) -> str:
    return f"{row[0]}/{row[1]}" if feed in LOGS else str(row[0])


def row_place(feed: str, row: tuple) -> tuple:
    """place() of a row's cursor."""
    return (row[0], row[1]) if feed in LOGS else (row[0],)


def beyond(feed: str, row: tuple, after: str) -> bool:
    """Whether a feed that goes on from a cursor gives this row."""
    return row[0] >= after.partition("/")[0] if feed == "deletes" else row_place(feed, row) > place(feed, after)


class Transport(ABC):
    """Where feeds come from; it is pickled and used on the driver and in tasks."""

    @abstractmethod
    def latest(self, feed: str) -> str | None:
        """The cursor of the feed's last row; None while it has none."""

    @abstractmethod
    def cuts(self, feed: str, after: str, until: str) -> list[str]:
        """Cursors from which on the rows between the two may be read apart, without `after` and up to `until`: a task for each."""

    @abstractmethod
    def rows(self, feed: str, after: str, until: str) -> Iterator[tuple]:
        """The rows that the feed gives from a cursor on (see beyond()), up to and with another."""


#: Rows of a file, in whole pages, and the most tasks of one read: folders, listings and tasks don't grow with the number of pages.
ROWS_A_FILE = 100_000
MOST_SPANS = 1000


class Pages(Transport):
    """Feeds in a folder of the shared store, as write_pages() writes them: folders of many pages, named by their last cursor, in whose files each page is a row group. Pages may be added at any time."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _folders(self, feed: str) -> list[tuple[tuple, str, str]]:
        """(place, cursor, path) of each folder, by its last cursor."""
        from pyarrow import fs

        store, top = filesystem(f"{self.path}/{feed}")
        found = store.get_file_info(fs.FileSelector(top, allow_not_found=True))
        names = [(unquote(x.base_name.partition("=")[2]), x.path) for x in found if x.base_name.startswith("upto=")]
        return sorted((place(feed, c), c, p) for c, p in names)

    def latest(self, feed: str) -> str | None:
        folders = self._folders(feed)
        return folders[-1][1] if folders else None

    def cuts(self, feed: str, after: str, until: str) -> list[str]:
        since, upto = place(feed, after), place(feed, until)
        inner = [c for p, c, _ in self._folders(feed) if since < p < upto]
        each = len(inner) // MOST_SPANS + 1
        return [*inner[each - 1 :: each], until]

    def rows(self, feed: str, after: str, until: str) -> Iterator[tuple]:
        from pyarrow import fs

        names = [c.split()[0] for c in COLUMNS[feed].split(", ")]
        again = feed == "deletes"
        since, upto, stamp = place(feed, after), place(feed, until), after.partition("/")[0]
        store = filesystem(self.path)[0]
        for last, cursor, path in self._folders(feed):
            if last < since and not (again and cursor.partition("/")[0] == stamp):
                continue
            for file in sorted(x.path for x in store.get_file_info(fs.FileSelector(path)) if x.base_name.endswith(".parquet")):
                for page in self._pages(store, file, names):
                    yield from sorted((r for r in page if (r[0] >= stamp if again else row_place(feed, r) > since) and row_place(feed, r) <= upto), key=lambda r: row_place(feed, r))
            if last >= upto:
                return

    @staticmethod
    def _pages(store, file: str, names: list[str]) -> Iterator[Iterator[tuple]]:
        """The rows of each page of a file, of which one is held at a time."""
        import pyarrow.parquet as pq

        with store.open_input_file(file) as opened:
            pages = pq.ParquetFile(opened)
            for i in range(pages.num_row_groups):
                table = pages.read_row_group(i, columns=names)
                yield zip(*(table[c].to_pylist() for c in names), strict=True)


def write_pages(rows: DataFrame, path: str, feed: str, size: int) -> None:
    """Add a feed's rows, which must come after those that are there, as pages of `size` rows."""
    names = [c.split()[0] for c in COLUMNS[feed].split(", ")]
    cursor = F.concat_ws("/", *names[:2]) if feed in LOGS else F.col(names[0]).cast("string")
    numbered = positions(rows.select(*names), names[:2], out="__n")
    held = numbered.withColumn("__file", F.floor((F.col("__n") - 1) / (max(1, ROWS_A_FILE // size) * size)))
    ends = held.groupBy("__file").agg(F.max_by(cursor, F.col("__n")).alias("upto")).withColumnRenamed("__file", "__f")
    files = held.join(ends, F.col("__file") == F.col("__f")).repartition("upto").sortWithinPartitions("upto", "__n")
    files.select(*names, "upto").write.mode("append").option("parquet.block.row.count.limit", str(size)).option("maxRecordsPerFile", "0").partitionBy("upto").parquet(f"{path.rstrip('/')}/{quote(feed)}")


class Span(InputPartition):
    def __init__(self, after: str, until: str):
        self.after, self.until = after, until


class _Rows:
    """What batches and streams share: spans between cursors, and their rows."""

    def __init__(self, transport: Transport, feed: str):
        self.transport, self.feed = transport, feed

    def spans(self, after: str, until: str) -> list[Span]:
        if place(self.feed, after) >= place(self.feed, until):
            return []
        cuts = [c for c in self.transport.cuts(self.feed, after, until) if place(self.feed, c) > place(self.feed, after)]
        return [Span(a, b) for a, b in zip([after, *cuts], cuts)]

    def batches(self, span: Span, first: str, size: int = 10_000) -> Iterator[pa.RecordBatch]:
        """Rows of a span, each in one span only; `first` is the cursor at which the whole read begins, whose timestamp the delete log reads again."""
        schema, held, since = arrow_schema(self.feed), [], place(self.feed, span.after)
        for row in self.transport.rows(self.feed, span.after, span.until):
            if span.after != first and row_place(self.feed, row) <= since:
                continue
            held.append(row)
            if len(held) == size:
                yield _batch(held, schema)
                held = []
        if held:
            yield _batch(held, schema)


def arrow_schema(feed: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in COLUMNS[feed].split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


class _Batch(_Rows, DataSourceReader):
    def __init__(self, transport: Transport, feed: str, after: str, until: str | None):
        super().__init__(transport, feed)
        self.after, self.until = after, until

    def partitions(self) -> list[Span]:
        until = self.until or self.transport.latest(self.feed)
        return self.spans(self.after, until) if until else []

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if span is not None:
            yield from self.batches(span, self.after)


class _Stream(_Rows, DataSourceStreamReader):
    def __init__(self, transport: Transport, feed: str, after: str):
        super().__init__(transport, feed)
        self.after = after

    def initialOffset(self) -> dict:
        return {"cursor": self.after}

    def latestOffset(self) -> dict:
        return {"cursor": self.transport.latest(self.feed) or self.after}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        spans = self.spans(start["cursor"], end["cursor"])
        for s in spans:
            s.first = start["cursor"]
        return spans

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        yield from self.batches(span, span.first)


def feed_source(transport: Transport) -> type[DataSource]:
    """The data source `wikifeed` over a transport. Options: feed, after (a cursor; from the beginning without), until (batches only)."""

    class WikiFeed(DataSource):
        @classmethod
        def name(cls) -> str:
            return "wikifeed"

        def _feed(self) -> str:
            feed = self.options.get("feed", "")
            if feed not in COLUMNS:
                raise ValueError(f"feed must be one of {', '.join(COLUMNS)}")
            return feed

        def schema(self) -> str:
            return COLUMNS[self._feed()]

        def reader(self, schema) -> DataSourceReader:
            return _Batch(transport, self._feed(), self.options.get("after", "0"), self.options.get("until"))

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Stream(transport, self._feed(), self.options.get("after", "0"))

    return WikiFeed


def read_feed(spark: SparkSession, feed: str, after: str | None = None, until: str | None = None) -> DataFrame:
    options = {k: v for k, v in (("feed", feed), ("after", after), ("until", until)) if v is not None}
    return spark.read.format("wikifeed").options(**options).load()


def page_tasks(rows: DataFrame, feed: str) -> DataFrame:
    """Index tasks of a feed's rows; their cursor has been seen to by the source."""
    make = {"requests": W.request_tasks, "revisions": W.revision_tasks, "deletes": W.delete_tasks, "moves": W.move_tasks, "all": W.all_page_tasks}
    return make[feed](rows)

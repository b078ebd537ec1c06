"""An index in segments: each batch of changes adds one, and segments are merged as they become many.

A segment holds, for the keys that its batch changed, their new rows, or that they are gone;
with `fields` it also holds the postings of its rows. A key's newest segment counts. A manifest
lists the segments from oldest to newest and the last batch that is in them. It is written in
one step after its segments, so a batch is in the index whole or not at all, and a batch
that comes again changes nothing. There is one writer at a time; readers keep the segments of the
manifest that they read until two further ones are written.

Merges are by size: levels are powers of `fan` in rows. Once `fan` of the newest segments are of
one level, they and all newer ones become one. So a row is written about once a level, and there are
fan - 1 segments a level at most.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ancestra.operators import postings as P
from ancestra.sources.store import Store
from ancestra.sources.wiki import DELETE

GONE = "__gone"
#: Manifests whose segments are kept.
KEPT = 2


def value_counts(rows: DataFrame, fields: tuple[str, ...], sign: int = 1) -> DataFrame:
    """(field, value, count): rows a value of each field, each value of an array once a row; null values don't count."""
    arrays = {f.name: isinstance(f.dataType, T.ArrayType) for f in rows.schema.fields}
    values = lambda f: F.array_distinct(F.coalesce(F.col(f), F.array().cast("array<string>"))) if arrays[f] else F.array(F.col(f).cast("string"))
    each = F.concat(*[F.transform(values(f), _named(f)) for f in fields])
    return rows.select(F.explode(each).alias("x")).select("x.*").where("value is not null").groupBy("field", "value").agg((F.lit(sign) * F.count(F.lit(1))).alias("count"))


def _named(field: str):
    return lambda v: F.struct(F.lit(field).alias("field"), v.cast("string").alias("value"))


def summed(*counts: DataFrame) -> DataFrame:
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy("field", "value").agg(F.sum("count").alias("count")).where("count <> 0")


class Segments:
    """The segments below `root`: an index of distinct keys.

    fields: those whose postings are kept (operators.postings). counted: those whose values' numbers of rows are
    kept: each segment holds by how much its batch changes them, so that a facet is a sum over small tables.
    fan, least: when to merge; segments of up to `least` rows are of the same level.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "page_id", fields: tuple[str, ...] = (), fan: int = 4, least: int = 1000, counted: tuple[str, ...] = ()):
        self.spark, self.key, self.fields, self.fan, self.least, self.counted = spark, key, fields, fan, least, counted
        self.store = Store(spark, root)

    def manifest(self) -> dict | None:
        """The last one: number, batch, segments (name, rows, bytes), schema."""
        names = self.store.names("manifest-")
        return json.loads(self.store.read(names[-1])) if names else None

    def create(self, index: DataFrame, batch: int = -1) -> None:
        """Begin with an index; its columns are those of the segments."""
        if self.manifest() is not None:
            raise ValueError(f"{self.store.root} holds segments already")
        schema = index.schema.json()
        self._commit(None, batch, [self._write("segment-base", index.withColumn(GONE, F.lit(False)), schema)], schema)

    def _read(self, segment: dict, schema: str) -> DataFrame:
        columns = T.StructType.fromJson(json.loads(schema)).add(GONE, T.BooleanType())
        return self.spark.read.schema(columns).parquet(self.store.path(f"{segment['name']}/rows"))

    def _newest(self, segments: list[dict], read, schema: str) -> DataFrame:
        """Of what read() gives of each segment the rows whose key no newer segment has."""
        out, newer = None, None
        for s in reversed(segments):
            rows, keys = read(s), self._read(s, schema).select(F.col(self.key).alias("__newer"))
            rows = rows if newer is None else rows.join(newer, F.col(self.key) == F.col("__newer"), "left_anti")
            out = rows if out is None else out.unionByName(rows)
            newer = keys if newer is None else newer.unionByName(keys)
        return out

    def index(self) -> DataFrame:
        """The rows that count."""
        m = self.manifest()
        return self._newest(m["segments"], lambda s: self._read(s, m["schema"]), m["schema"]).where(~F.col(GONE)).drop(GONE)

    def postings(self) -> DataFrame:
        """The postings of the rows that count, as operators.postings.read() gives them."""
        m = self.manifest()
        found = self._newest(m["segments"], lambda s: P.read(self.spark, self.store.path(f"{s['name']}/postings")), m["schema"])
        return found.withMetadata("term", {"fields": list(self.fields)})

    def counts(self, field: str) -> DataFrame:
        """(value, count) of a counted field over the rows that count: kept current, not counted anew."""
        parts = [self._counts(s) for s in self.manifest()["segments"]]
        return summed(*parts).where(F.col("field") == field).select("value", "count")

    def _counts(self, segment: dict) -> DataFrame:
        return self.spark.read.schema("field string, value string, count long").parquet(self.store.path(f"{segment['name']}/counts"))

    def _write(self, name: str, rows: DataFrame, schema: str, old: list[dict] | None = None, replaced: DataFrame | None = None) -> dict:
        """Write a segment; its postings and counts come from its rows (and those that they replace) or, in a merge, from those of the old ones."""
        rows.repartitionByRange(self.key).sortWithinPartitions(self.key).write.mode("overwrite").parquet(self.store.path(f"{name}/rows"))
        written = self._read({"name": name}, schema)
        if self.fields and old is None:
            P.write(written.where(~F.col(GONE)), self.store.path(f"{name}/postings"), self.fields, self.key)
        elif self.fields:
            found = self._newest(old, lambda s: P.read(self.spark, self.store.path(f"{s['name']}/postings")), schema)
            P.write_rows(found, self.store.path(f"{name}/postings"), self.fields, self.key)
        if self.counted:
            if old is not None:
                changes = summed(*[self._counts(s) for s in old])
            else:
                changes = value_counts(written.where(~F.col(GONE)), self.counted)
                changes = summed(changes, value_counts(replaced, self.counted, -1)) if replaced is not None else changes
            changes.select("field", "value", "count").write.mode("overwrite").parquet(self.store.path(f"{name}/counts"))
        return {"name": name, "rows": written.count(), "bytes": self.store.size(name)}

    def _commit(self, before: dict | None, batch: int, segments: list[dict], schema: str) -> None:
        number = before["number"] + 1 if before else 0
        self.store.write(f"manifest-{number:012d}", json.dumps({"number": number, "batch": batch, "segments": segments, "schema": schema}))
        manifests = self.store.names("manifest-")
        kept = {s["name"] for name in manifests[-KEPT:] for s in json.loads(self.store.read(name))["segments"]}
        for name in [*manifests[:-KEPT], *(x for x in self.store.names("segment-") if x not in kept)]:
            self.store.delete(name)

    def apply(self, batch: int, changes: DataFrame, gone: DataFrame) -> bool:
        """Add a batch of changed rows (distinct keys) and of keys that are gone (a key in both is changed); whether it was new."""
        m = self.manifest()
        if batch <= m["batch"]:
            return False
        columns = T.StructType.fromJson(json.loads(m["schema"])).names
        lost = gone.select(self.key).distinct().join(changes.select(F.col(self.key).alias("__k")), F.col(self.key) == F.col("__k"), "left_anti")
        rows = changes.select(*columns, F.lit(False).alias(GONE)).unionByName(lost.withColumn(GONE, F.lit(True)), allowMissingColumns=True)
        keys = rows.select(F.col(self.key).alias("__k"))
        replaced = self.index().join(keys, F.col(self.key) == F.col("__k"), "left_semi") if self.counted else None
        added = self._write(f"segment-{batch:012d}", rows, m["schema"], replaced=replaced)
        segments = [*m["segments"], added] if added["rows"] else m["segments"]
        self._commit(m, batch, segments, m["schema"])
        while self.merge():
            pass
        return True

    def level(self, segment: dict) -> int:
        return max(0, math.floor(math.log(max(segment["rows"], 1) / self.least, self.fan))) if segment["rows"] else 0

    def merge(self, whole: bool = False) -> bool:
        """Merge the newest segments if `fan` of them are of one level (or all of them); whether there was something to do.

        Only a merge that includes the oldest segment may forget what is gone.
        """
        m = self.manifest()
        segments = m["segments"]
        first, at, same = 0 if whole else None, -1, 0
        for i in () if whole else range(len(segments) - 1, -1, -1):  # a segment older than a larger one counts as of its level
            above = max(at, self.level(segments[i]))
            at, same = above, same + 1 if above == at else 1
            if same >= self.fan:
                first = min(i for i in range(len(segments)) if max(map(self.level, segments[i:])) <= at)
                break
        if first is None or len(segments) - first < 2:
            return False
        old = segments[first:]
        rows = self._newest(old, lambda s: self._read(s, m["schema"]), m["schema"])
        rows = rows.where(~F.col(GONE)) if first == 0 else rows
        name = f"segment-{m['batch']:012d}-{m['number'] + 1:012d}" if m["batch"] >= 0 else f"segment-base-{m['number'] + 1:012d}"
        self._commit(m, m["batch"], [*segments[:first], self._write(name, rows, m["schema"], old)], m["schema"])
        return True

    def optimize(self) -> None:
        """One segment."""
        self.merge(whole=True)


def apply_tasks(segments: Segments, batch: int, tasks: DataFrame, pages: DataFrame) -> bool:
    """A batch of index tasks, as streaming.incremental.applied() takes them, added to the segments.

    pages has the segments' columns and `is_redirect`; key: page_id, revisions: rev_id. Each batch looks its pages up
    among all of them, so a source with many revisions a page is better reduced by streaming.incremental.newest(), and stored, once.
    """
    from ancestra.streaming.incremental import deduplicated, guarded, newest

    if batch <= segments.manifest()["batch"]:
        return False
    todo = guarded(deduplicated(tasks), segments.index().select("page_id", "rev_id")).select("page_id", "action").persist()  # a row a page at most, for the changed and the gone
    try:
        updates = todo.where(F.col("action") != DELETE).select(F.col("page_id").alias("__p"))
        fresh = newest(pages.join(updates, F.col("page_id") == F.col("__p"), "left_semi"))
        return segments.apply(batch, fresh.where("not is_redirect"), todo.select("page_id"))
    finally:
        todo.unpersist()


def run_stream(tasks: DataFrame, pages: DataFrame, segments: Segments, checkpoint: str) -> StreamingQuery:
    """Apply a stream of tasks to the segments, all that is available, then stop; a repeated micro-batch changes nothing."""

    def step(batch: DataFrame, number: int) -> None:
        apply_tasks(segments, number, batch, pages)

    return tasks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

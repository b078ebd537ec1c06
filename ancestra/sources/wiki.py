"""Wiki dumps, change feeds, tables of a database, and the sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ancestra.functions import text

UPDATE, DELETE = 0, 1
TASKS = "feed string, sequence_id string, page_id string, action int, rev_id long, rev_timestamp string"


@dataclass(frozen=True)
class Config:
    """Settings of incremental indexing."""

    max_time: int = 280
    foreground_delay: int = 10
    background_delay: int = 20
    background_pages: int = 0
    tasks_per_request: int = 5000
    batch_size: int = 50

    @classmethod
    def read(cls, path: str) -> Config:
        """From a properties file: name = value lines, # for comments; unknown names are ignored."""
        names = {f.name for f in fields(cls)}
        with open(path) as f:
            pairs = [line.split("=", 1) for line in f if "=" in line and not line.lstrip().startswith("#")]
        return cls(**{k.strip(): int(v) for k, v in pairs if k.strip() in names})


def read_dump(spark: SparkSession, path: str, skip_redirects: bool = True) -> DataFrame:
    """(page_id, title, rev_id, text) of a MediaWiki dump: the text of each page's highest revision. Read by Spark's XML source, in splits."""
    raw = spark.read.format("xml").option("rowTag", "page").schema("id string, title string, revision array<struct<id: long, text: string>>").load(path)
    last = F.array_max(F.transform("revision", lambda r: F.struct(r["id"].alias("id"), r["text"].alias("text"))))
    pages = raw.select(F.col("id").alias("page_id"), "title", last["id"].alias("rev_id"), last["text"].alias("text"))
    return pages.where(~F.coalesce(text.is_redirect("text"), F.lit(False))) if skip_redirects else pages


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(word): the lines of a word list, without blank ones and comments."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> '' and not word like '#%'").distinct()


def read_sound_examples(spark: SparkSession, path: str) -> DataFrame:
    """(code, examples) of lines "code: name, name"."""
    parts = F.split("value", ":", 2)
    return spark.read.text(path).where("value like '%:%'").select(F.trim(F.get(parts, 0)).alias("code"), F.transform(F.split(F.get(parts, 1), ","), lambda x: F.trim(x)).alias("examples"))


def read_jdbc(spark: SparkSession, url: str, table: str, user: str, password: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16) -> DataFrame:
    """A table of a database; with a partition column it is read in that many ranges at once."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, user=user, password=password)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, user: str, password: str, mode: str = "append", batch: int = 500) -> None:
    """Write or append rows in batches; "overwrite" empties the table and keeps its definition."""
    df.write.format("jdbc").options(url=url, dbtable=table, user=user, password=password, batchsize=batch, truncate=True).mode(mode).save()


def _tasks(df: DataFrame, feed: str, sequence, page, action, rev_id=None, timestamp=None) -> DataFrame:
    return df.select(
        F.lit(feed).alias("feed"), sequence.cast("string").alias("sequence_id"), page.cast("string").alias("page_id"), action.cast("int").alias("action"),
        (F.lit(0) if rev_id is None else rev_id).cast("long").alias("rev_id"), (F.lit(None) if timestamp is None else timestamp).cast("string").alias("rev_timestamp"),
    )


def request_tasks(requests: DataFrame, after: int = 0) -> DataFrame:
    """Updates of the index requests (ir_id, page_id) after a cursor."""
    return _tasks(requests.where(F.col("ir_id") > after), "requests", F.col("ir_id"), F.col("page_id"), F.lit(UPDATE))


def revision_tasks(revisions: DataFrame, after: int = 0) -> DataFrame:
    """Updates of the revisions (rev_id, page_id, rev_timestamp) after a cursor."""
    return _tasks(revisions.where(F.col("rev_id") > after), "revisions", F.col("rev_id"), F.col("page_id"), F.lit(UPDATE), F.col("rev_id"), F.col("rev_timestamp"))


def delete_tasks(log: DataFrame, from_timestamp: str = "0") -> DataFrame:
    """Deletes and, for any other action, updates of a delete log (timestamp, page_id, action); the cursor's own row is read again."""
    cursor = F.concat_ws("/", "timestamp", "page_id")
    return _tasks(log.where(F.col("timestamp") >= from_timestamp), "deletes", cursor, F.col("page_id"), F.when(F.lower("action") == "delete", DELETE).otherwise(UPDATE))


def move_tasks(log: DataFrame, after: str = "0") -> DataFrame:
    """Of a move log (timestamp, source_id, target_id): a delete of the source and an update of the target, each only for an id that isn't 0."""
    cursor = F.concat_ws("/", "timestamp", "source_id")
    both = F.array(F.struct(F.col("source_id").cast("string").alias("id"), F.lit(DELETE).alias("a")), F.struct(F.col("target_id").cast("string").alias("id"), F.lit(UPDATE).alias("a")))
    each = log.where(cursor > after).select(cursor.alias("c"), F.explode(both).alias("t")).where("t.id is not null and t.id <> '0'")
    return _tasks(each, "moves", F.col("c"), F.col("t.id"), F.col("t.a"))


def all_page_tasks(pages: DataFrame, after: str = "0", most: int | None = None, namespaces: tuple[int, ...] | None = None) -> DataFrame:
    """Updates of all pages (page_id, namespace where namespaces are asked for) after a cursor, or of the next `most` of them."""
    left = pages.where(F.col("page_id").cast("long") > int(after))
    if namespaces is not None:
        left = left.where(F.col("namespace").isin(*namespaces))
    if most is not None:
        left = left.orderBy(F.col("page_id").cast("long")).limit(most)
    return _tasks(left, "all", F.col("page_id"), F.col("page_id"), F.lit(UPDATE))


def all_pages_cursor(tasks: DataFrame, after: str, most: int, roll_over: bool) -> DataFrame:
    """One row (sequence_id, at_end): where to go on after a page of all_page_tasks().

    A page of fewer than `most` tasks is the last one: then the cursor starts anew where it rolls over, and else stays at the end.
    """
    seen = tasks.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("sequence_id").cast("long")).cast("string").alias("last"))
    short = F.col("n") < most
    return seen.select(F.when(short & F.lit(roll_over), "0").otherwise(F.coalesce("last", F.lit(after))).alias("sequence_id"), (short & F.lit(not roll_over)).alias("at_end"))


def write_versioned(df: DataFrame, root: str, version: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write a new version of an index as a folder of its own, so that readers of the last one aren't disturbed."""
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return path


def compacted(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df in even partitions of about `rows` rows."""
    return df.repartition(max(1, -(-df.count() // rows)))


def parse_update_xml(spark: SparkSession, messages: DataFrame, column: str = "xml") -> DataFrame:
    """(action, page_id, fields) of update messages: <add><doc><field name="">…</field></doc></add> and <delete><id>…</id></delete>. Malformed ones give nothing."""
    import xml.etree.ElementTree as ET

    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for x in f[column]:
                try:
                    root = ET.fromstring(x or "")
                except ET.ParseError:
                    continue
                for d in root.iter("doc"):
                    values: dict[str, list[str]] = {}
                    for e in d.iter("field"):
                        values.setdefault(e.get("name") or "", []).append(e.text or "")
                    out.append(("add", (values.get("PageId") or [None])[0], json.dumps(values)))
                if root.tag == "delete":
                    out += [("delete", e.text, None) for e in root.iter("id")]
                if root.tag in ("commit", "optimize"):
                    out.append((root.tag, None, None))
            yield pd.DataFrame(out, columns=["action", "page_id", "fields"])

    return messages.select(column).mapInPandas(run, "action string, page_id string, fields string").withColumn("fields", F.from_json("fields", "map<string, array<string>>"))

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ancestra.session import cut, shared_dir, ship_package  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data by its logical name."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def unused(df: DataFrame, name: str) -> str:
    """A column name that df hasn't, whatever their case: the given one with as many _ as it takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def filesystem(path: str):
    """(pyarrow file system, path inside it) of a path or URI; usable on executors."""
    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def pieces(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[tuple[int, list]]:
    """The bytes values of a string column in slices of bounded size: (first row, values).

    A slice ends once it holds `most` bytes, so one very long text is alone in its slice.
    """
    values = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_string(values.type):
        values = values.cast(pa.binary())
    elif pa.types.is_large_string(values.type):
        values = values.cast(pa.large_binary())
    start, held = 0, 0
    sizes = pc.binary_length(values).to_pylist()
    for i, n in enumerate(sizes):
        held += n or 0
        if held >= most:
            yield start, values.slice(start, i + 1 - start).to_pylist()
            start, held = i + 1, 0
    if start < len(values):
        yield start, values.slice(start).to_pylist()


_LIVE: list[weakref.ref] = []


def only(*mine: Cache) -> None:
    """Empty all caches of this process but these: a worker that goes on to another operator needs the last one's no more."""
    for r in _LIVE:
        c = r()
        if c is not None and not any(c is m for m in mine):
            c.clear()


class Cache(dict):
    """A dictionary that is emptied when full; it holds no result that can't be made again."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most
        _LIVE[:] = [r for r in _LIVE if r() is not None]
        _LIVE.append(weakref.ref(self))

    def room(self) -> None:
        if len(self) >= self.most:
            self.clear()

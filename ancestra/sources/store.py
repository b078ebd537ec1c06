"""Small files and folders of the shared store, through Hadoop's file system API."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """A folder of the store that Spark reads and writes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path(name))

    def names(self, prefix: str) -> list[str]:
        """Names in the folder that begin so, in order."""
        if not self.fs.exists(self._path("")):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self.fs.listStatus(self._path(""))) if n.startswith(prefix))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write a new small file: under another name first, so that it is there whole or not at all. One that is there already is an error."""
        stream = self.fs.create(self._path(f".{name}.new"), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.fs.exists(self._path(name)) or not self.fs.rename(self._path(f".{name}.new"), self._path(name)):
            raise FileExistsError(self.path(name))

    def size(self, name: str) -> int:
        """Bytes of a file, or of all files below a folder."""
        return self.fs.getContentSummary(self._path(name)).getLength()

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def filesystem(path: str):
    """(pyarrow file system, path inside it) of a path or URI; usable in tasks."""
    from urllib.parse import urlparse

    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)

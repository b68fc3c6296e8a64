"""Small files and folders through the session's file systems, so that pointers and ledgers work wherever the tables lie."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Taken(RuntimeError):
    """A file that was to be new is there already: another writer was faster."""


class Files:
    """Listing, reading and writing of small files under any path that Spark can read."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str, folders: bool | None = None) -> list[str]:
        """Names in a folder in order; only folders, or only files, if asked for. A folder that is not there has none."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        found = [(s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(p)]
        return sorted(n for n, d in found if folders is None or d == folders)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str, new: bool = False) -> None:
        """Write a text file; with new it must not be there yet."""
        fs, p = self._at(path)
        if new and fs.exists(p):
            raise Taken(path)
        try:
            stream = fs.create(p, not new)
        except Exception as e:
            if new and "AlreadyExists" in str(e):
                raise Taken(path) from e
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        if fs.exists(p):
            fs.delete(p, True)

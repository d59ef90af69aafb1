"""Folder operations on whatever file system a table's path names (driver side, one call a folder)."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """The Hadoop file system of ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._utf8 = jvm.java.nio.charset.StandardCharsets.UTF_8
        self._io = jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str, folders: bool = True) -> list[str]:
        """Names of the sub-folders (or files) of a folder, sorted; none if it does not exist."""
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)) if s.isDirectory() == folders)

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def move(self, old: str, new: str) -> None:
        """Rename a folder or file; the target must not exist, its parent is made."""
        self._fs.mkdirs(self._path(new).getParent())
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"could not move {old} to {new}")

    def write(self, path: str, text: str) -> None:
        """A small file, whole or not at all: written aside and renamed."""
        aside = f"{path}.tmp"
        out = self._fs.create(self._path(aside), True)
        try:
            out.write(text.encode("utf-8"))
        finally:
            out.close()
        if self.exists(path):
            self.delete(path)
        self.move(aside, path)

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._io.toString(stream, self._utf8)
        finally:
            stream.close()

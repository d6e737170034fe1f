"""Folders on any file system that Spark reaches, for small files the driver owns."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder for a store without a path: where driver and executors share a disk a temporary
    one, on a cluster one under spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/marlstone-{kind}-{uuid.uuid4().hex}"
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("on a cluster a store needs a path, or spark.checkpoint.dir for those without one")
    return tempfile.mkdtemp(prefix=f"marlstone-{kind}-")


class Folder:
    """A folder through Hadoop's file system interface."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = path.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._at("").getFileSystem(self.conf)
        self.fs.mkdirs(self._at(""))

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str, overwrite: bool) -> None:
        stream = self.fs.create(self._at(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Replaces a file at once: readers see the old text or the new."""
        self._write(f".{name}.new", text, True)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        array = self._array(rename, [rename.OVERWRITE])
        context.rename(self._at(f".{name}.new"), self._at(name), array)

    def move(self, name: str, to: str) -> bool:
        """Renames a file; not if it is gone or there is one of that name."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        try:
            context.rename(self._at(name), self._at(to), self._array(rename, [rename.NONE]))
            return True
        except Exception:
            if self.exists(to) or not self.exists(name):
                return False
            raise

    def _array(self, kind, values):
        from pyspark import SparkContext

        out = SparkContext._active_spark_context._gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    def create(self, name: str, text: str) -> bool:
        """Makes a file if there is none; whether this call made it."""
        try:
            self._write(name, text, False)
            return True
        except Exception:
            if self.exists(name):
                return False
            raise

    def touch(self, name: str) -> None:
        """Writes an empty file anew; there is one at any time."""
        self._write(name, "", True)

    def modified_ms(self, name: str) -> int:
        return self.fs.getFileStatus(self._at(name)).getModificationTime()

    def delete(self, name: str) -> bool:
        return self.fs.delete(self._at(name), True)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at("")))

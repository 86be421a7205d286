"""A folder in any file system that Hadoop knows, as the store needs it."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession


class Folder:
    """Small files and names below ``path``; data files are Spark's business."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self.root = self._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.root)

    def at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.root, name)

    def uri(self, name: str) -> str:
        return self.fs.makeQualified(self.at(name)).toString()

    def create(self, name: str, content: bytes, sync: bool = False) -> bool:
        """Write a new file, with ``sync`` down to the disk; false if it exists already."""
        try:
            out = self.fs.create(self.at(name), False)
        except Exception as e:
            if "exist" in str(e):
                return False
            raise
        out.write(bytearray(content))
        if sync:
            out.hsync()
        out.close()
        return True

    def touch(self, name: str, content: bytes) -> None:
        """Write a file again, so that it counts as new."""
        out = self.fs.create(self.at(name), True)
        out.write(bytearray(content))
        out.close()

    def age(self, name: str) -> float | None:
        """Seconds since a file was written; None if there is none."""
        if not self.fs.exists(self.at(name)):
            return None
        return time.time() - self.fs.getFileStatus(self.at(name)).getModificationTime() / 1000

    def read(self, name: str) -> bytes:
        source = self.fs.open(self.at(name))
        try:
            return bytes(source.readAllBytes())
        finally:
            source.close()

    def names(self, name: str) -> list[str]:
        if not self.fs.exists(self.at(name)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(name)))

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.at(name)).getLength() if self.fs.exists(self.at(name)) else 0

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

"""Small driver-side file operations on any file system that Hadoop reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..errors import InvalidInput


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def make(self, path: str) -> None:
        self.fs.mkdirs(self._path(path))

    def names(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._path(path)))

    def times(self, path: str) -> dict[str, int]:
        """Name and time of the last change, in milliseconds, of what a folder holds."""
        if not self.exists(path):
            return {}
        return {x.getPath().getName(): x.getModificationTime() for x in self.fs.listStatus(self._path(path))}

    def size(self, path: str) -> int:
        return self.fs.getContentSummary(self._path(path)).getLength() if self.exists(path) else 0

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def rename(self, old: str, new: str) -> bool:
        return self.fs.rename(self._path(old), self._path(new))

    def read(self, path: str) -> bytes:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, path: str, data: bytes, sync: bool = True) -> bool:
        """Write a file that must not exist; False if it does. ``sync`` waits until it is on disk."""
        p = self._path(path)
        if self.fs.exists(p):
            return False
        try:
            stream = self.fs.create(p, False)
        except Exception as e:  # another writer was first
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        try:
            stream.write(bytearray(data))
            stream.hsync() if sync else stream.hflush()
        finally:
            stream.close()
        return True


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder all executors reach, below ``spark.checkpoint.dir``; without that a local one,
    which only a local master allows."""
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        shared = current.get() if current.isDefined() else None
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise InvalidInput("on a cluster, spark.checkpoint.dir names the folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="strandlog-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

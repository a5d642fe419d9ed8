"""File operations through Hadoop's FileSystem, so any store that Spark reads will do."""

from __future__ import annotations

import contextlib
import os
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)
        self.local = self.fs.getUri().getScheme() == "file"

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def bytes(self, name: str = "") -> int:
        return self.fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file; false if there is one of that name.  On a local disk a hard link
        makes the whole file appear at once; elsewhere the store's exclusive create decides."""
        if self.local:
            target = self._path(name).toUri().getPath()
            os.makedirs(os.path.dirname(target), exist_ok=True)
            part = f"{target}.{uuid.uuid4().hex}.part"
            with open(part, "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(part, target)
            except FileExistsError:
                return False
            finally:
                with contextlib.suppress(FileNotFoundError):
                    os.unlink(part)
            return True
        try:
            stream = self.fs.create(self._path(name), False)
        except Exception:
            if self.exists(name):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

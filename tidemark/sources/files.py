"""Small files and folders on whatever file system a path names, through Hadoop's client."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def list(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.exists(name) else []

    def size(self, name: str) -> int:
        return int(self.fs.getContentSummary(self.path(name)).getLength()) if self.exists(name) else 0

    def read_json(self, name: str):
        stream = self.fs.open(self.path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write_json(self, name: str, value) -> None:
        """A new file, whole or not at all: written beside, then renamed to a name that must not be taken.

        File systems may refuse to rename onto a file, or do it unawares; so nothing is ever replaced.
        """
        new = f"{name}.{uuid.uuid4().hex}.new"
        stream = self.fs.create(self.path(new), True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        if self.exists(name) or not self.fs.rename(self.path(new), self.path(name)):
            self.fs.delete(self.path(new), False)
            raise FileExistsError(f"{self.root}/{name}")

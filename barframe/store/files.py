"""Small files and folders on any file system that Spark reaches, by the Hadoop API."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def system(self, name: str):
        return self.path(name).getFileSystem(self.conf)

    def exists(self, name: str) -> bool:
        return self.system(name).exists(self.path(name))

    def make(self, name: str) -> None:
        self.system(name).mkdirs(self.path(name))

    def delete(self, name: str) -> None:
        self.system(name).delete(self.path(name), True)

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.system(name).listStatus(self.path(name))) if self.exists(name) else []

    def size(self, name: str) -> int:
        return self.system(name).getContentSummary(self.path(name)).getLength()

    def move(self, old: str, new: str) -> None:
        if not self.system(old).rename(self.path(old), self.path(new)):
            raise OSError(f"can't move {old} to {new}")

    def renamed(self, old: str, new: str) -> bool:
        """Rename a file; False if it is gone, as of several processes only one succeeds."""
        try:
            return bool(self.system(old).rename(self.path(old), self.path(new)))
        except Exception:
            if self.exists(old):
                raise
            return False

    def overwrite(self, name: str, text: str) -> None:
        stream = self.system(name).create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def read(self, name: str) -> str:
        stream = self.system(name).open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not exist; False if it does."""
        try:
            stream = self.system(name).create(self.path(name), False)
        except Exception:
            if self.exists(name):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def publish(self, name: str, text: str) -> None:
        """Replace a file so that readers see the old or the new one, whole."""
        fresh = f"{name}.{uuid.uuid4().hex}.tmp"
        self.create(fresh, text)
        kept = f"{name}.old"
        if self.exists(name):
            if self.exists(kept):
                self.delete(kept)
            self.move(name, kept)
        self.move(fresh, name)
        if self.exists(kept):
            self.delete(kept)

    def load(self, name: str) -> Any:
        """A published file; its predecessor if a writer stopped between the two moves."""
        if not self.exists(name) and self.exists(f"{name}.old"):
            name = f"{name}.old"
        return json.loads(self.read(name))

    def has(self, name: str) -> bool:
        return self.exists(name) or self.exists(f"{name}.old")

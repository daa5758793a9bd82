"""Small files by Hadoop's file systems, so that any store that Spark reads will do."""

from __future__ import annotations

import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._jvm = jvm
        self.root = root.rstrip("/")
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self._at(folder)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at(folder)))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, data: bytes, overwrite: bool = True) -> None:
        stream = self.fs.create(self._at(name), overwrite)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Publishes a new file; False if the name is taken. The content is complete before the name exists.

        A claim on the name holds where the content lies, so that whoever finds the claim of a dead writer publishes for it.
        """
        staged = f"_staged/{self._jvm.java.util.UUID.randomUUID().toString()}"
        self.write(staged, text.encode())
        try:
            self.write(name + ".claim", staged.encode(), overwrite=False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            self.settle(name)
            self.delete(staged)
            return False
        # another writer may have settled this claim meanwhile
        return bool(self.fs.rename(self._at(staged), self._at(name))) or self.exists(name)

    def settle(self, name: str, grace: float = 60.0) -> None:
        """Publishes the content that a claim names if its writer hasn't; a claim that names none goes after ``grace`` seconds."""
        claim = name + ".claim"
        if self.exists(name) or not self.exists(claim):
            return
        staged = self.read(claim)
        if staged and self.exists(staged):
            self.fs.rename(self._at(staged), self._at(name))
        elif self.age(claim) > grace and not self.exists(name):
            self.delete(claim)

    def age(self, name: str) -> float:
        """Seconds since the last change of a file or of the newest file in a folder."""
        at = self._at(name)
        times = [s.getModificationTime() for s in self.fs.listStatus(at)] or [self.fs.getFileStatus(at).getModificationTime()]
        return time.time() - max(times) / 1000

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def exists(self, name: str) -> bool:
        return bool(self.fs.exists(self._at(name)))

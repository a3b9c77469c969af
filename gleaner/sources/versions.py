"""Versions of a small table under a folder, put in place by compare-and-set.

A version is written aside and renamed to its number; the rename fails where the number is taken. So a reader sees a whole version or
none, and of two writers that saw the same version one loses. That holds on file systems whose rename of a folder is atomic (HDFS and
its like, local disks); on plain object stores it does not.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has put the version in place."""


class Versions:
    """The versions under ``root`` (any path that Spark writes to), each a table with ``schema``."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        home = self._path(self.root)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = home.getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(home.toUri() if home.toUri().getScheme() else self._fs.getUri(), conf)
        self._fs.mkdirs(home)

    def numbers(self) -> list[int]:
        """All versions, oldest first."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[1:]) for n in names if n.startswith("v"))

    def latest(self) -> int:
        """The latest version, 0 before the first."""
        return (self.numbers() or [0])[-1]

    def read(self, version: int | None = None) -> DataFrame:
        """A version (the latest); before the first, no rows."""
        version = self.latest() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/v{version:010d}")

    def put(self, df: DataFrame, version: int) -> int:
        """Put ``df`` in place as ``version``; ``Conflict`` if that exists."""
        aside = f"{self.root}/_{uuid.uuid4().hex}"
        df.write.parquet(aside)
        options = self.spark.sparkContext._gateway.new_array(getattr(self.spark.sparkContext._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._files.rename(self._path(aside), self._path(f"{self.root}/v{version:010d}"), options)
        except Py4JJavaError as e:
            self._fs.delete(self._path(aside), True)
            if "AlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {version} exists") from e
            raise
        return version

    def remove(self, path: str) -> None:
        """Delete a folder of the store, if it is there."""
        self._fs.delete(self._path(path), True)

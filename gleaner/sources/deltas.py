"""A keyed table as a base and files of changes, with versions by compare-and-set."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from gleaner.sources.versions import Conflict, Versions

RUNS = "run string, kind string, batch long, fields string"
DELTAS = 8  # files of changes after which they are merged into the base


class KeyedTable:
    """Rows by ``key``, of which the one of the highest ``order`` counts (the latest change, among equal ones).

    A change writes only its own rows and a new version of the list of runs. It names the version that it was made from: if another writer
    was there first, ``Conflict`` is raised and nothing has changed. Every ``DELTAS`` changes, one more version holds a merged base.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, order: str, deltas: int = DELTAS):
        self.spark, self.root, self.key, self.order, self.deltas = spark, root.rstrip("/"), key, order, deltas
        self.versions = Versions(spark, f"{self.root}/versions", RUNS)

    def version(self) -> int:
        return self.versions.latest()

    def _runs(self, version: int) -> list:
        """The base and the changes since, in order: at most ``deltas + 1``."""
        return sorted(self.versions.read(version).collect(), key=lambda r: (r["kind"], r["batch"]))

    def read(self, version: int | None = None, schema: StructType | None = None) -> DataFrame:
        """The rows of a version (the latest): each key's last change. Before the first change an empty table of ``schema``."""
        runs = self._runs(self.version() if version is None else version)
        if not runs:
            return self.spark.createDataFrame([], schema or StructType())
        parts = [self._part(r["run"], r["fields"]).withColumn("__run", F.lit(i)) for i, r in enumerate(runs)]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p, allowMissingColumns=True)
        if len(runs) == 1:
            return every.drop("__run")
        rest = [c for c in every.columns if c not in (self.key, "__run")]
        latest = F.max_by(F.struct(*rest), F.struct(F.col(self.order), F.col("__run"))).alias("s")
        return every.groupBy(self.key).agg(latest).select(self.key, "s.*").select(*[c for c in every.columns if c != "__run"])

    def _part(self, run: str, fields: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(fields))).parquet(f"{self.root}/runs/{run}")

    def _write(self, rows: DataFrame, kind: str, batch: int) -> tuple:
        run = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/runs/{run}")
        return run, kind, batch, rows.schema.json()

    def apply(self, changes: DataFrame, expected: int | None = None, batch: int | None = None) -> int:
        """Add ``changes`` (of a key the last by ``order``) as a version after ``expected`` (the latest) and return it.

        ``batch``: the number of a stream's batch; one that is there already, or older than the last, is not added again.
        """
        version = self.version()
        if expected is not None and expected != version:
            raise Conflict(f"version {expected} was changed")
        runs = self._runs(version)
        last = max((r["batch"] for r in runs), default=-1)
        if batch is not None and batch <= last:
            return version
        number = last + 1 if batch is None else batch
        rest = [c for c in changes.columns if c != self.key]
        own = changes.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.col(self.order)).alias("s")).select(self.key, "s.*").select(*changes.columns)
        added = self.spark.createDataFrame([self._write(own, "base" if not runs else "delta", number)], RUNS)
        version = self.versions.put(self.versions.read(version).unionByName(added).coalesce(1), version + 1)
        return self.merge() if len(runs) >= self.deltas else version

    def merge(self) -> int:
        """Write the rows of the latest version as its base and return the version; the runs before stay for readers of older versions."""
        version = self.version()
        runs = self._runs(version)
        if len(runs) < 2:
            return version
        base = self._write(self.read(version), "base", max(r["batch"] for r in runs))
        try:
            return self.versions.put(self.spark.createDataFrame([base], RUNS).coalesce(1), version + 1)
        except Conflict:  # another writer has gone on: the merge is left to the next change
            self.versions.remove(f"{self.root}/runs/{base[0]}")
            return self.version()

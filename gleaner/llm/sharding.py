"""Shards of a table: small immutable appends, size-tiered compaction, versioned manifests.

A store is a folder. ``runs/`` holds the shards (Parquet files that never change) by the
write that made them; ``manifests/v...`` holds one table of live shards for each version; ``schema/`` holds a table without
rows for each schema that was appended. A version is written aside and put in place by one rename that fails where the name exists, so a
reader sees a whole version or none, and of two writers one loses and tries again. That holds on file systems
whose rename of a folder is atomic (HDFS and its like, local disks); on plain object stores it does not.

Compaction sorts the live shards into tiers by size. A tier with enough shards is
merged by one job that reads shards side by side, as many as make a target-sized
file, and writes each set as one file: no shuffle, and a row moves at most once for each tier.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

TARGET_BYTES = 128 << 20
FANOUT = 4
ARRIVALS = 16  # lots that a loaded table is dealt to
LARGE_EVERY, LARGE_TIMES = 4, 16  # every fourth lot is sixteen times as large as the others
FULL = 0.75  # of the target: a shard of this size is not merged any more
MANIFEST = "shard string, run string, n_rows long, n_bytes long, since long"


class Conflict(RuntimeError):
    """Another writer has put the version in place."""


class MergedElsewhere(RuntimeError):
    """Another writer has removed what this one merged."""


def tier_of(n_bytes: Column, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT) -> Column:
    """0 for full shards, else how many steps of ``fanout`` below the target a shard's size is."""
    steps = F.floor(F.log(float(fanout), F.lit(float(target_bytes)) / F.greatest(n_bytes, F.lit(1)))) + 1
    return F.when(n_bytes >= int(FULL * target_bytes), 0).otherwise(F.greatest(steps, F.lit(1))).cast("int")


class ShardStore:
    """A versioned table of shards under ``root`` (any path that Spark writes to)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        home = self._path(f"{self.root}/manifests")
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = home.getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(home.toUri() if home.toUri().getScheme() else self._fs.getUri(), conf)
        self._fs.mkdirs(home)
        self._fs.mkdirs(self._path(f"{self.root}/runs"))

    def versions(self) -> list[int]:
        """All versions, oldest first."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return sorted(int(n[1:]) for n in names if n.startswith("v"))

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live shards of a version (the latest): ``shard, run, n_rows, n_bytes, since``; before the first, no rows."""
        known = self.versions()
        if version is None and not known:
            return self.spark.createDataFrame([], MANIFEST)
        version = known[-1] if version is None else version
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/v{version:010d}")

    def commit(self, manifest: DataFrame, version: int) -> int:
        """Put ``manifest`` in place as ``version`` atomically; ``Conflict`` if that exists."""
        aside = f"{self.root}/manifests/_{uuid.uuid4().hex}"
        manifest.select("shard", "run", "n_rows", "n_bytes", "since").write.parquet(aside)
        return self._place(aside, version)

    def _place(self, aside: str, version: int) -> int:
        options = self.spark.sparkContext._gateway.new_array(getattr(self.spark.sparkContext._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._files.rename(self._path(aside), self._path(f"{self.root}/manifests/v{version:010d}"), options)
        except Py4JJavaError as e:
            self._fs.delete(self._path(aside), True)
            if "AlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {version} exists") from e
            raise
        return version

    def _describe(self, run: str, schema: StructType) -> DataFrame:
        """The shards of a written run (``run`` may be a pattern): files without rows are none."""
        back = self.spark.read.schema(schema).parquet(f"{self.root}/runs/{run}")
        file = back.metadataColumn("_metadata")
        shard = F.regexp_extract(file["file_path"], "/runs/(.+)$", 1)
        counted = back.select(shard.alias("shard"), file["file_size"].alias("n_bytes")).groupBy("shard", "n_bytes").agg(F.count("*").alias("n_rows"))
        since = F.regexp_extract("shard", "^([0-9]+)-", 1).cast("long")
        return counted.select("shard", F.regexp_extract("shard", "^(.*)/[^/]*$", 1).alias("run"), "n_rows", "n_bytes", since.alias("since"))

    def _write(self, df: DataFrame, since: int, lot: Column | None = None) -> DataFrame:
        """Write a run, or with ``lot`` one for each lot of rows, and describe its shards."""
        run = f"{since:010d}-{uuid.uuid4().hex[:8]}"
        if lot is None:
            df.write.option("compression", "zstd").parquet(f"{self.root}/runs/{run}")
            return self._describe(run, df.schema)
        name = f"lot{uuid.uuid4().hex[:8]}"  # a column that no table has
        df.withColumn(name, lot).write.partitionBy(name).option("compression", "zstd").parquet(f"{self.root}/runs/{run}")
        wrote = self._fs.globStatus(self._path(f"{self.root}/runs/{run}/*=*"))
        return self._describe(f"{run}/*=*", df.schema) if wrote else self.spark.createDataFrame([], MANIFEST)

    def _remember(self, schema: StructType) -> None:
        """Keep a schema with the store, so that a store without rows has its columns too."""
        name = hashlib.sha256(schema.json().encode()).hexdigest()[:16]
        self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema)).write.mode("ignore").parquet(f"{self.root}/schema/{name}")

    def _put(self, change: Callable[[DataFrame], DataFrame], attempts: int = 5) -> int:
        """Commit a changed manifest over the latest one, again if another writer was first."""
        for _ in range(attempts):
            latest = (self.versions() or [0])[-1]
            try:
                return self.commit(change(self.manifest()).coalesce(1 + latest // 1000), latest + 1)
            except Conflict:
                continue
        raise Conflict(f"gave up after {attempts} attempts")

    def append(self, df: DataFrame, attempts: int = 5) -> int:
        """Add the rows of ``df`` as new shards, one for each of its partitions, and return the new version.

        Rows are stored as they are, nulls and repeated rows included. No rows: no new version, but the columns are kept.
        """
        self._remember(df.schema)
        since = (self.versions() or [0])[-1] + 1
        added = self._write(df, since).collect()  # a row for each new file, as the write's own commit has on the driver
        if not added:
            return since - 1
        found = self.spark.createDataFrame(added, MANIFEST)
        return self._put(lambda live: live.unionByName(found), attempts)

    def append_lots(self, df: DataFrame, lot: Column, lots: int) -> int:
        """Add the rows of ``df`` as ``lots`` arrivals in a row (``lot``: 0 to ``lots - 1``), each its own version; return the latest.

        All are written by one scan; each task writes a shard for each lot that it has rows of. A lot without rows makes no version.
        """
        self._remember(df.schema)
        since = (self.versions() or [0])[-1] + 1
        aside = f"{self.root}/manifests/_{uuid.uuid4().hex}"
        number = F.regexp_extract("run", "=([0-9]+)$", 1).cast("int")
        self._write(df, since, lot).withColumn("lot", number).write.parquet(aside)
        found = self.spark.read.schema(f"{MANIFEST}, lot int").parquet(aside)
        present = sorted(r["lot"] for r in found.select("lot").distinct().collect())
        latest, base = (self.versions() or [0])[-1], self.manifest()
        # each version holds what was live before and the lots up to its own; one job writes them all, then each is put in place
        upto = lambda first: F.explode(F.sequence(first, F.lit(len(present) - 1))).alias("upto")
        own = found.select("shard", "run", "n_rows", "n_bytes", "since", upto((F.array_position(F.array(*map(F.lit, present)), F.col("lot")) - 1).cast("int")))
        several = f"{self.root}/manifests/_{uuid.uuid4().hex}"
        if present:
            base.select("shard", "run", "n_rows", "n_bytes", "since", upto(F.lit(0))).unionByName(own).coalesce(1 + latest // 1000).write.partitionBy("upto").parquet(several)
        for i, lot in enumerate(present):
            try:
                self._place(f"{several}/upto={i}", latest + 1 + i)
            except Conflict:  # another writer has come between: the rest goes over its versions
                for late in present[i:]:
                    self._put(lambda live, late=late: live.unionByName(found.where(F.col("lot") == late).drop("lot")))
                break
        for path in (several, aside):
            self._fs.delete(self._path(path), True)
        return (self.versions() or [0])[-1]

    def tiers(self, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT) -> DataFrame:
        """``tier, shards, n_rows, n_bytes`` of the latest version."""
        m = self.manifest().withColumn("tier", tier_of(F.col("n_bytes"), target_bytes, fanout))
        return m.groupBy("tier").agg(F.count("*").alias("shards"), F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))

    def compact(self, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT) -> int:
        """Merge tiers of ``fanout`` shards or more, smallest shards first, until there is none; return the latest version.

        Merged files have one to two times the target size, or less if that is all there is; every merge leaves fewer shards. Each merge is one version. Readers of older versions are not disturbed. ``MergedElsewhere`` if another compaction has
        taken the same shards; shards that were appended meanwhile stay.
        """
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        while True:
            due = [r["tier"] for r in self.tiers(target_bytes, fanout).collect() if r["tier"] > 0 and r["shards"] >= fanout]
            if not due:
                return (self.versions() or [0])[-1]
            self._merge(max(due), target_bytes, fanout)

    def _merge(self, tier: int, target_bytes: int, fanout: int) -> None:
        own = self.manifest().where(tier_of(F.col("n_bytes"), target_bytes, fanout) == tier)
        shards, n_bytes = (list(x) for x in zip(*own.select("shard", "n_bytes").collect(), strict=True))  # file names, as a scan's own file index has them
        # whole shards side by side, whatever a scan's own partitions are; fewer files than there were, as none of them is near the target
        rows = self.spark.read.schema(self.schema()).parquet(*(f"{self.root}/runs/{s}" for s in shards)).coalesce(max(1, sum(n_bytes) // target_bytes))
        latest = (self.versions() or [0])[-1]
        merged = self.spark.createDataFrame(self._write(rows, latest + 1).collect(), MANIFEST)
        gone = self.spark.createDataFrame([(s,) for s in shards], "shard string")

        def change(live: DataFrame) -> DataFrame:
            if live.join(gone, "shard", "left_semi").count() != len(shards):
                raise MergedElsewhere("shards of this tier were merged by another writer")
            return live.join(gone, "shard", "left_anti").unionByName(merged)

        self._put(change)

    def schema(self) -> StructType:
        """The columns of everything that was ever appended."""
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/schema/*").schema

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the latest), with ``__shard`` and ``__shard_bytes`` (in place of stored columns of these names);
        columns that a shard lacks are null. A store without rows gives no rows, with the columns of what was appended."""
        shards = [r["shard"] for r in self.manifest(version).select("shard").collect()]
        if not shards:
            known = self._fs.exists(self._path(f"{self.root}/schema"))
            df = self.spark.read.parquet(f"{self.root}/schema/*") if known else self.spark.range(0).select()
            return df.where("false").withColumns({"__shard": F.lit(None).cast("string"), "__shard_bytes": F.lit(None).cast("long")})
        df = self.spark.read.schema(self.schema()).parquet(*(f"{self.root}/runs/{s}" for s in shards))
        file = df.metadataColumn("_metadata")
        return df.withColumns({"__shard": F.regexp_extract(file["file_path"], "/runs/(.+)$", 1), "__shard_bytes": file["file_size"]})

    def expire(self, keep: int = 1, grace_seconds: float = 86_400) -> int:
        """Drop all but the latest ``keep`` versions and the runs that no kept version names; return how many runs went.

        Runs and manifests that no version names at all, as failed writers leave them, go once they have not been touched for ``grace_seconds``
        (a writer that is still at work is younger).
        """
        known = self.versions()
        old, kept = known[:-keep], known[-keep:]
        runs = lambda vs: {r["run"] for v in vs for r in self.manifest(v).select("run").distinct().collect()}
        live = runs(kept)
        gone = runs(old) - live
        for v in old:
            self._fs.delete(self._path(f"{self.root}/manifests/v{v:010d}"), True)
        for run in gone:
            self._fs.delete(self._path(f"{self.root}/runs/{run}"), True)
        named, before = {run.split("/")[0] for run in live}, 1000 * (time.time() - grace_seconds)
        for folder, keeps in (("runs", lambda name: name in named), ("manifests", lambda name: name.startswith("v"))):
            for status in self._fs.listStatus(self._path(f"{self.root}/{folder}")):
                name = status.getPath().getName()
                if not keeps(name) and (status.getModificationTime() <= before or name in {run.split("/")[0] for run in gone}):
                    self._fs.delete(status.getPath(), True)
        return len(gone)


def load_table(store: ShardStore, df: DataFrame, arrivals: int = ARRIVALS) -> int:
    """Append the rows of a table as ``arrivals`` lots of two sizes, dealt by a hash of the whole row, and return the version.

    Repeated rows arrive together. An empty table leaves its columns and no version.
    """
    shares = [LARGE_TIMES if i % LARGE_EVERY == LARGE_EVERY - 1 else 1 for i in range(arrivals)]
    place = F.pmod(F.xxhash64(*(F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema)), F.lit(sum(shares)))
    lot = F.lit(arrivals - 1)
    for i in reversed(range(arrivals - 1)):
        lot = F.when(place < sum(shares[: i + 1]), i).otherwise(lot)
    return store.append_lots(df, lot, arrivals)

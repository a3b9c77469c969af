"""A persisted index of tokens: postings sorted by token, pruned by ranges, kept up by what is new."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner.sources.versions import Versions

FILES = "run string, file string, low string, high string, n long"
RUNS = 8  # runs after which the postings are written anew as one


def tokens(columns: Sequence[str]) -> Column:
    """The different tokens (letters and digits, without case) of some text columns."""
    text = F.lower(F.concat_ws(" ", *(F.col(c) for c in columns)))
    return F.array_distinct(F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda t: t != ""))


class TokenIndex:
    """Postings ``token, key`` under ``root``, in runs of files that are sorted by token and then by key.

    The manifest, one version for each change, holds the first and last token of each file, so a search opens only the files that a prefix can be in, and
    within them Parquet skips row groups by their own ranges. A token of very many rows lies in several files, as ranges go on by key. Two
    writers that change the same version do not lose rows: one of them gets ``Conflict`` and adds again.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, columns: Sequence[str]):
        self.spark, self.root, self.key, self.columns = spark, root.rstrip("/"), key, list(columns)
        self.versions = Versions(spark, f"{self.root}/manifests", FILES)

    def _runs(self) -> list[str]:
        return sorted(r["run"] for r in self.versions.read().select("run").distinct().collect())

    def _keys(self) -> DataFrame | None:
        runs = self._runs()
        return self.spark.read.parquet(*(f"{self.root}/runs/{r}/keys" for r in runs)) if runs else None

    def _write(self, postings: DataFrame, keys: DataFrame) -> DataFrame:
        """Write a run and return its files for the manifest; a run without postings has one row without a file."""
        run = uuid.uuid4().hex
        at = f"{self.root}/runs/{run}"
        keys.write.parquet(f"{at}/keys")
        postings.repartitionByRange("token", "key").sortWithinPartitions("token", "key").write.option("parquet.block.size", 8 << 20).parquet(f"{at}/postings")
        back = self.spark.read.schema(postings.schema).parquet(f"{at}/postings")
        file = back.metadataColumn("_metadata")["file_name"]
        files = back.select(file.alias("file"), "token").groupBy("file").agg(F.min("token").alias("low"), F.max("token").alias("high"), F.count("*").alias("n"))
        none = self.spark.createDataFrame([(run, None, None, None, 0)], FILES)
        return files.select(F.lit(run).alias("run"), "file", "low", "high", "n").unionByName(none)

    def add(self, items: DataFrame) -> int:
        """Index the rows whose key is not indexed yet, of repeated keys one row; return the version. Null keys are left out. No new rows: no new version."""
        rows = items.where(F.col(self.key).isNotNull()).dropDuplicates([self.key]).select(F.col(self.key).alias("key"), tokens(self.columns).alias("tokens"))
        version, known = self.versions.latest(), self._keys()
        if known is not None:
            rows = rows.join(known, "key", "left_anti")
        fresh = self._staged(rows)
        if not fresh.head(1):
            return version
        added = self._write(fresh.select(F.explode("tokens").alias("token"), "key"), fresh.select("key"))
        version = self.versions.put(self.versions.read().unionByName(added), version + 1)
        return self.compact() if len(self._runs()) > RUNS else version

    def _staged(self, rows: DataFrame) -> DataFrame:
        path = f"{self.root}/staged/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def compact(self) -> int:
        """Write all postings anew as one run; return the version. The old runs stay for readers of older versions."""
        version, runs = self.versions.latest(), self._runs()
        if len(runs) < 2:
            return version
        read = lambda part: self.spark.read.parquet(*(f"{self.root}/runs/{r}/{part}" for r in runs))
        return self.versions.put(self._write(read("postings"), read("keys")), version + 1)

    def postings(self, prefix: str) -> DataFrame | None:
        """``token, key`` of the tokens that begin with ``prefix`` (lower case), from the files whose ranges it meets; None if there are none."""
        above = prefix + "\U0010ffff"
        near = self.versions.read().where(F.col("file").isNotNull() & (F.col("high") >= prefix) & (F.col("low") <= above))
        paths = [f"{self.root}/runs/{r['run']}/postings/{r['file']}" for r in near.select("run", "file").collect()]  # the files of one range of tokens
        return self.spark.read.parquet(*paths).where(F.startswith("token", F.lit(prefix))) if paths else None

    def search(self, terms: Sequence[str]) -> DataFrame:
        """``key`` of the rows in which every term begins some token; without terms none.

        The terms' ranges are counted first; then the keys of the rarest are narrowed by the others, from rare to frequent.
        """
        found = [self.postings(t.lower()) for t in dict.fromkeys(terms)]
        known = self._keys()
        if known is None:
            raise ValueError("the index has no rows yet")
        if not found or any(f is None for f in found):
            return known.limit(0).select(F.col("key").alias(self.key))
        if len(found) > 1:
            counts = None
            for i, f in enumerate(found):
                one = f.agg(F.count("*").alias("n")).select(F.lit(i).alias("i"), "n")
                counts = one if counts is None else counts.unionByName(one)
            sizes = {r["i"]: r["n"] for r in counts.collect()}
            found = [f for _, f in sorted(enumerate(found), key=lambda x: sizes[x[0]])]
        keys = found[0].select("key").distinct()
        for more in found[1:]:
            keys = more.select("key").join(keys, "key", "left_semi").distinct()
        return keys.select(F.col("key").alias(self.key))

"""Lines that many documents share, found by levelled sorted runs of line hashes.

A line's key is the line without white space at both ends, A-Z lower-cased; it is known by 128 bits of hash. A batch of documents is counted
once (documents by key, repeats within a document once) and merge-anti-joined with the runs there are: a key that a run already holds as frequent
need not be counted again. What is left becomes a run of level 0. Where a level has ``FANOUT`` runs, they are merged into one of the next
level, summing counts. A run is a table bucketed and sorted by hash, so neither the anti-join nor a merge shuffles the runs, only the batch.

Rows with null or empty text have one empty line. Equal rows are documents of their own; ids may be null or repeat. Keys shorter than
``MIN_CHARS`` code points are never frequent. An empty table has no frequent lines and gives no rows. Only the id and text columns are read, whatever
others there are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gleaner.session import shared_dir
from gleaner.sources.versions import Versions

LEAST_DOCS = 10
MIN_CHARS = 1
FANOUT = 2
LOTS = 4  # batches that a loaded table is dealt to
RECOUNT = 1000  # a key with as many documents in one batch is counted on though known as frequent, so that hot keys can be told
HOT = 4096  # most frequent keys, found where documents are read; 64 KB
SPACE = " \t\n\x0b\x0c\r"
RUN = StructType([StructField(c, LongType(), False) for c in ("h1", "h2", "n")])


def _hashes(x: Column, salt: str) -> list[Column]:
    return [F.xxhash64(x), F.xxhash64(F.lit(salt), x)]


def _keys(text: Column, min_chars: int) -> Column:
    """For each line its hashes, or null where the key is too short."""
    lines = F.split(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "\n", -1)

    def key(line: Column) -> Column:
        own = F.trim(line, F.lit(SPACE))
        h1, h2 = _hashes(own, "line")
        return F.when(F.char_length(own) >= min_chars, F.struct(h1.alias("h1"), h2.alias("h2")))

    return F.transform(lines, key)


class LineRuns:
    """Runs of line hashes under ``root``. ``buckets`` (the session's shuffle partitions) is fixed by the first run."""

    def __init__(self, spark: SparkSession, root: str, least: int = LEAST_DOCS, min_chars: int = MIN_CHARS, fanout: int = FANOUT):
        self.spark, self.root, self.least, self.min_chars, self.fanout = spark, root.rstrip("/"), least, min_chars, fanout
        self.versions = Versions(spark, f"{self.root}/manifests", "run string, level int, buckets int")

    def runs(self) -> list[tuple[str, int, int]]:
        """Name, level and buckets of the live runs: ``fanout`` for each level at most, whatever the table's size."""
        return sorted((tuple(r) for r in self.versions.read().collect()), key=lambda r: (r[1], r[0]))

    def _put(self, version: int, runs: list[tuple[str, int, int]]) -> int:
        return self.versions.put(self.spark.createDataFrame(runs, self.versions.schema).coalesce(1), version + 1)

    def _write(self, counts: DataFrame, buckets: int) -> str:
        run = f"lines_{uuid.uuid4().hex}"
        rows = counts.select(*(F.col(c) for c in RUN.names))
        rows.write.bucketBy(buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.root}/runs/{run}").option("compression", "none").saveAsTable(run)
        return run

    def _read(self, run: str, buckets: int) -> DataFrame:
        if not self.spark.catalog.tableExists(run):  # a store of an earlier session
            self.spark.sql(f"CREATE TABLE {run} (h1 BIGINT, h2 BIGINT, n BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {buckets} BUCKETS LOCATION '{self.root}/runs/{run}'")
        return self.spark.table(run)

    def add(self, docs: DataFrame, text: str = "text") -> int:
        """Count a batch's lines, leave out those that a run holds as frequent, add the rest as a run, compact; return the version.

        Of two writers that add at the same time one gets ``Conflict``; its run is not part of the store.
        """
        version, live = self.versions.latest(), self.runs()
        buckets = live[0][2] if live else int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        own = docs.select(F.explode(F.array_distinct(_keys(F.col(text), self.min_chars))).alias("k")).where("k is not null")
        counts = own.groupBy(F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2")).agg(F.count("*").alias("n"))
        for run, _, size in live:
            known = self._read(run, size).where(F.col("n") >= self.least).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"))
            same = (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & (F.col("n") < RECOUNT)
            counts = counts.join(known.hint("merge"), same, "left_anti")
        live.append((self._write(counts, buckets), 0, buckets))
        version = self._put(version, live)
        while due := [level for level in {r[1] for r in live} if sum(r[1] == level for r in live) >= self.fanout]:
            version, live = self._merge(version, live, [r for r in live if r[1] == min(due)])
        return version

    def _merge(self, version: int, live: list[tuple[str, int, int]], old: list[tuple[str, int, int]]) -> tuple[int, list[tuple[str, int, int]]]:
        live = [r for r in live if r not in old] + [(self._write(self._summed(old), old[0][2]), max(r[1] for r in old) + 1, old[0][2])]
        version = self._put(version, live)
        for run, _, size in old:  # no reader of the version before the last is promised them
            self._read(run, size)
            self.spark.sql(f"DROP TABLE {run}")
            self.versions.remove(f"{self.root}/runs/{run}")
        return version, live

    def _summed(self, runs: list[tuple[str, int, int]]) -> DataFrame:
        """The counts of several runs, merged two at a time by their buckets: two runs meet without a shuffle."""
        if not runs:
            return self.spark.createDataFrame([], RUN)
        out = self._read(runs[0][0], runs[0][2])
        for run, _, size in runs[1:]:
            more = self._read(run, size).withColumnRenamed("n", "more")
            both = out.join(more.hint("merge"), ["h1", "h2"], "full")
            out = both.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))
        return out

    def compact(self) -> int:
        """Merge all runs into one; return the version."""
        version, live = self.versions.latest(), self.runs()
        return self._merge(version, live, live)[0] if len(live) > 1 else version

    def frequent(self) -> DataFrame:
        """``h1, h2, n``: the keys of ``least`` documents or more. ``n`` is exact up to ``least`` and at least a batch's own count if that is ``RECOUNT`` or more."""
        return self._summed(self.runs()).where(F.col("n") >= self.least)

    def clean(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """``doc_id, n_lines, n_dropped, kept``: every row's text without its frequent lines (all of them dropped: the empty string).

        Lines meet the frequent keys by hash alone. The ``HOT`` most frequent keys are found by a broadcast where documents are read, and their lines are
        dealt by place afterwards, so no task gets the lines of one hot key. Equal rows with equal ids share one list of dropped places.
        """
        t1, t2 = _hashes(F.coalesce(F.col(text), F.lit("")), "text")
        own = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), t1.alias("t1"), t2.alias("t2"))
        frequent = self.frequent()
        hot = frequent.orderBy(F.desc("n"), "h1", "h2").limit(HOT).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.lit(True).alias("is_hot"))
        lines = own.select("id", "t1", "t2", F.posexplode(_keys(F.col("text"), self.min_chars)).alias("place", "k")).where("k is not null")
        lines = lines.select("id", "t1", "t2", "place", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"))
        lines = lines.join(F.broadcast(hot), (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left").drop("k1", "k2")
        dealt = lines.withColumn("h1", F.when(F.col("is_hot"), F.xxhash64("t1", "t2", "place")).otherwise(F.col("h1")))
        found = dealt.join(frequent.select(F.col("h1").alias("k1"), F.col("h2").alias("k2")), (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
        gone = found.where("is_hot or k1 is not null").groupBy("id", "t1", "t2").agg(F.collect_set("place").alias("gone"))
        gone = gone.select(F.col("id").alias("id_"), F.col("t1").alias("t1_"), F.col("t2").alias("t2_"), "gone")
        both = own.join(gone, own["id"].eqNullSafe(gone["id_"]) & (own["t1"] == gone["t1_"]) & (own["t2"] == gone["t2_"]), "left")
        whole = F.split("text", "\n", -1)
        both = both.select("id", F.size(whole).cast("long").alias("n_lines"), F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_dropped"), "text", "gone")
        places = F.array_except(F.sequence(F.lit(0), F.col("n_lines").cast("int") - 1), F.col("gone"))
        line = F.col("lines")
        kept = F.array_join(F.transform(places, lambda i: F.get(line, i)), "\n")
        some = both.withColumn("lines", F.when(F.col("n_dropped") > 0, F.split("text", "\n", -1)))
        return some.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.when(F.col("n_dropped") > 0, kept).otherwise(F.col("text")).alias("kept"))


def load(store: LineRuns, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lots: int = LOTS) -> int:
    """Add a whole table in ``lots`` batches by a hash of the id, then compact; return the version."""
    lot = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(lots))
    for i in range(lots):
        store.add(docs.where(lot == i), text)
    return store.compact()


def drop_frequent(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``LineRuns.clean`` over a table, by runs of its own lines. Loading runs when this is called."""
    spark = docs.sparkSession
    store = LineRuns(spark, f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}", least, min_chars)
    load(store, docs, doc_id, text)
    return store.clean(docs, doc_id, text)

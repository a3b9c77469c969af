"""Files as items: recursive scans, inserts, moved files, relocated folders, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.utils import AnalysisException

from gleaner.functions.text import replace_prefix

# The file types that are indexed.
EXTENSIONS = (
    "jpg", "jpeg", "png", "webp", "avif", "tiff", "tif", "heic", "heif", "gif", "bmp", "ico",
    "cr2", "cr3", "nef", "nrw", "arw", "srf", "sr2", "dng", "orf", "rw2", "raf", "pef", "rwl", "3fr", "raw",
)
# Texts that no indexed path has in it.
SKIPPED = ("node_modules", ".git", ".thumbnails", ".cache")


def indexable(path: Column, extensions: Sequence[str] = EXTENSIONS, skipped: Sequence[str] = SKIPPED) -> Column:
    """A path with a known extension and none of the skipped texts anywhere in it."""
    parts = "|".join(s.replace(".", r"\.") for s in skipped)
    return F.lower(path).rlike(rf"\.({'|'.join(extensions)})$") & ~path.rlike(parts)


def scan(spark: SparkSession, root: str, extensions: Sequence[str] = EXTENSIONS, content: bool = False) -> DataFrame:
    """``path, folder, name, n_bytes, modified`` of the files below a folder; the contents are read only if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(indexable(F.col("path"), extensions))
    cols = ["path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified")]
    return files.select(*cols, *(["content"] if content else []))


SEGMENTS = 1024  # of a JPEG file that are gone through for its size


def image_header(content: Column) -> Column:
    """``format, width, height`` from the bytes of PNG, GIF, BMP, JPEG and WebP files; other formats have nulls. Plain byte arithmetic in the JVM."""
    part = lambda i, n: F.substr(content, i if isinstance(i, Column) else F.lit(i), F.lit(n))
    at = lambda i, n: F.conv(F.hex(part(i, n)), 16, 10).cast("long")
    small = lambda i, n: sum((at(i + j, 1) * (1 << 8 * j) for j in range(1, n)), at(i, 1))
    head = lambda i, n: F.hex(part(i, n))
    png, gif, bmp, jpeg = head(1, 8) == "89504E470D0A1A0A", head(1, 4) == "47494638", head(1, 2) == "424D", head(1, 3) == "FFD8FF"
    webp, kind = (head(1, 4) == "52494646") & (head(9, 4) == "57454250"), head(13, 4)
    low = lambda x, shift=0: F.shiftright(x, shift).bitwiseAND(F.lit(0x3FFF))

    def segment(state: Column, _: Column) -> Column:
        pos, marker = state["pos"], at(state["pos"] + 1, 1)
        frame = (marker >= 0xC0) & (marker <= 0xCF) & ~marker.isin(0xC4, 0xC8, 0xCC)
        none = F.lit(None).cast("long")
        after = F.when(at(pos, 1) == 0xFF, F.struct((pos + 2 + at(pos + 2, 2)).alias("pos"), none.alias("width"), none.alias("height")))
        found = F.struct(none.alias("pos"), at(pos + 7, 2).alias("width"), at(pos + 5, 2).alias("height"))
        return F.when(pos.isNull(), state).when(frame & (at(pos, 1) == 0xFF), found).otherwise(F.coalesce(after, F.struct(none.alias("pos"), none.alias("width"), none.alias("height"))))

    start = F.expr("named_struct('pos', 3L, 'width', cast(null as long), 'height', cast(null as long))")
    size = F.when(jpeg, F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), start, segment))
    wide = F.when(kind == "56503858", 1 + small(25, 3)).when(kind == "5650384C", 1 + low(small(22, 4))).when(kind == "56503820", low(small(27, 2)))
    high = F.when(kind == "56503858", 1 + small(28, 3)).when(kind == "5650384C", 1 + low(small(22, 4), 14)).when(kind == "56503820", low(small(29, 2)))
    return F.struct(
        F.when(png, "png").when(gif, "gif").when(bmp, "bmp").when(jpeg, "jpeg").when(webp, "webp").alias("format"),
        F.when(png, at(17, 4)).when(gif, small(7, 2)).when(bmp, small(19, 4)).when(jpeg, size["width"]).when(webp, wide).alias("width"),
        F.when(png, at(21, 4)).when(gif, small(9, 2)).when(bmp, small(23, 4)).when(jpeg, size["height"]).when(webp, high).alias("height"),
    )


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def sample_hash(content: Column, size: int = 4096) -> Column:
    """SHA-256 of the first and the last bytes; of the whole content where these would meet."""
    ends = F.concat(F.substring(content, 1, size), F.substring(content, -size, size))
    return F.sha2(F.when(F.length(content) <= 2 * size, content).otherwise(ends), 256)


def new_rows(incoming: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is not known; of repeated keys one row."""
    return incoming.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def insert_if_absent(incoming: DataFrame, path: str, key: str) -> DataFrame:
    """Append to a Parquet table the rows whose key it lacks; return what was added (from the rows, not from the table)."""
    spark = incoming.sparkSession
    try:
        known = spark.read.parquet(path).select(key)
    except AnalysisException:
        known = incoming.select(key).limit(0)
    fresh = new_rows(incoming, known, key)
    fresh.write.mode("append").parquet(path)
    return fresh


def counter(log: DataFrame, key: str, ts: str) -> DataFrame:
    """``key, n, last``: an upserted counter as the aggregate of its log."""
    return log.groupBy(key).agg(F.count("*").alias("n"), F.max(ts).alias("last"))


def adopt_moved(new: DataFrame, missing: DataFrame, tolerance_s: int = 5) -> DataFrame:
    """``new_id, old_id``: new files that are a missing one under another path: same name and size, dates within ``tolerance_s``, and no second candidate on either side.

    The range is joined through time buckets of its width, so the equi-join keys stay selective. Both: ``id, name, n_bytes, at`` (seconds).
    """
    width = tolerance_s + 1
    a = new.select(F.col("id").alias("new_id"), "name", "n_bytes", F.col("at").alias("na"), F.explode(F.array(*(F.floor(F.col("at") / width) + d for d in (-1, 0, 1)))).alias("b"))
    b = missing.select(F.col("id").alias("old_id"), "name", "n_bytes", F.col("at").alias("oa"), F.floor(F.col("at") / width).alias("b"))
    near = a.join(b, ["name", "n_bytes", "b"]).where(F.abs(F.col("na") - F.col("oa")) <= tolerance_s)
    one = near.groupBy("new_id").agg(F.count("*").alias("n"), F.min("old_id").alias("old_id")).where("n = 1")
    return one.groupBy("old_id").agg(F.count("*").alias("n"), F.min("new_id").alias("new_id")).where("n = 1").select("new_id", "old_id")


def relocated(old: DataFrame, new: DataFrame, share: float = 0.8, sample: int = 40, by: Column | None = None) -> DataFrame:
    """``old_folder, new_folder, hits, asked``: folders whose files turn up in exactly one new folder. Both: ``folder, name, n_bytes``.

    Up to ``sample`` files of an old folder vote, its first in the order ``by`` (by default of name hashes; the feature is a vote of a sample); all of them if it has fewer than 5, and then all must agree.
    """
    w = W.partitionBy("folder").orderBy(F.xxhash64("name") if by is None else by, "name")
    voters = old.withColumn("n", F.row_number().over(w)).where(F.col("n") <= sample).select(F.col("folder").alias("old_folder"), "name", "n_bytes")
    asked = voters.groupBy("old_folder").agg(F.count("*").alias("asked"))
    found = new.select(F.col("folder").alias("new_folder"), "name", "n_bytes").distinct()
    hits = voters.distinct().join(found, ["name", "n_bytes"]).groupBy("old_folder", "new_folder").agg(F.count("*").alias("hits"))
    passed = hits.join(asked, "old_folder").where(F.col("hits") >= F.when(F.col("asked") < 5, F.col("asked")).otherwise(F.ceil(F.col("asked") * share)))
    one = passed.groupBy("old_folder").agg(F.count("*").alias("k"), F.min("new_folder").alias("new_folder"), F.min("hits").alias("hits"), F.min("asked").alias("asked"))
    return one.where("k = 1").select("old_folder", "new_folder", "hits", "asked")


def move_paths(items: DataFrame, old: str, new: str, path: str = "path") -> DataFrame:
    return items.withColumn(path, replace_prefix(F.col(path), old, new))


def missing_files(items: DataFrame, listing: DataFrame, batch: str) -> DataFrame:
    """Items with ``missing_batch`` set where the listing lacks their path, and cleared where it has it again."""
    there = listing.select("path", F.lit(True).alias("there")).distinct()
    return items.drop("missing_batch").join(there, "path", "left").withColumn("missing_batch", F.when(F.col("there").isNull(), F.lit(batch))).drop("there")


def missing_by_folder(items: DataFrame, folder: str = "folder") -> DataFrame:
    """``folder, n, missing``: how many items a folder has, and how many of them ``missing_files`` has marked."""
    return items.groupBy(folder).agg(F.count("*").alias("n"), F.count("missing_batch").alias("missing"))


def reconcile(table: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """``key, problem``: ids that only the vector table has (orphan), that it has twice or more (duplicate), or that it lacks (absent)."""
    v = vectors.groupBy(key).agg(F.count("*").alias("nv"))
    both = table.select(key, F.lit(True).alias("in_t")).distinct().join(v, key, "full")
    problem = F.when(F.col("in_t").isNull(), "orphan").when(F.col("nv").isNull(), "absent").when(F.col("nv") > 1, "duplicate")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def snapshot(df: DataFrame, path: str, fingerprint: str) -> DataFrame:
    """``df`` from its snapshot if that has the same fingerprint, else computed, written and reread. A changed fingerprint is another folder, so readers of the old one are safe."""
    where = f"{path}/fingerprint={fingerprint}"
    spark = df.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
    if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        df.write.mode("overwrite").parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def fingerprint(*tables: DataFrame) -> str:
    """A text that changes with the rows of the tables: counts and sums of hashes."""
    parts = []
    for t in tables:
        r = t.agg(F.count("*"), F.sum(F.xxhash64(*t.columns).cast("decimal(38,0)"))).first()
        parts.append(f"{r[0]}-{r[1] or 0}")
    return "_".join(parts)


def export_rows(ids: DataFrame, items: DataFrame, details: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of an export: each asked item that exists once, with its details and its tag names in order (an empty list without tags).

    ``ids``: ``id``, repeats and nulls allowed; ``items``: ``id`` and what is shown; ``details``: one row an ``id`` or none; ``links``: ``id, name``. Only the asked items' details and
    tags are read on.
    """
    asked = ids.where("id is not null").select("id").distinct()
    names = links.join(asked, "id", "left_semi").groupBy("id").agg(F.sort_array(F.collect_set("name")).alias("tags"))
    shown = items.join(asked, "id", "left_semi").dropDuplicates(["id"])
    return shown.join(details.dropDuplicates(["id"]), "id", "left").join(names, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def export(items: DataFrame, path: str, fmt: str = "json", partition_by: Sequence[str] = ()) -> None:
    """Write items (one row a key) in any format that Spark writes."""
    writer = items.write.mode("overwrite").format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)

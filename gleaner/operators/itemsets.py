"""Sets of items by node as bitmaps: unions over subtrees and intersections of selections, without spreading links over ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.operators.hierarchy import Forest
from gleaner.session import materialise

WIDTH = 32_768  # items of one bucket, which is what a bitmap of 4 KB holds
FEW = 1024  # positions that take no more room than a bitmap


def item_of(bucket: Column, position: Column) -> Column:
    """The item (a long) at a position of a bucket: the reverse of ``bitmap_bucket_number`` and ``bitmap_bit_position``."""
    return F.when(bucket > 0, (bucket - 1) * WIDTH + position + 1).otherwise(bucket * WIDTH - position)


def containers(links: DataFrame, item: str, node: str) -> DataFrame:
    """``node, bucket, n, few, bits``: the different items (longs) of each node by bucket, as a list of positions (``few``) or, if there are more than ``FEW``, as a bitmap.

    Positions are combined map-side, and a set never has more than ``WIDTH``, so a node of very many links is one row for each bucket of items. Null nodes and
    items are left out.
    """
    rows = links.where(F.col(node).isNotNull() & F.col(item).isNotNull())
    sets = rows.groupBy(F.col(node).alias("node"), F.bitmap_bucket_number(item).alias("bucket")).agg(F.collect_set(F.bitmap_bit_position(item)).alias("at"))
    sets = materialise(sets, "item-sets")
    dense = sets.where(F.size("at") > FEW).select("node", "bucket", F.explode("at").alias("p")).groupBy("node", "bucket").agg(F.count("*").alias("n"), F.bitmap_construct_agg("p").alias("bits"))
    few = sets.where(F.size("at") <= FEW).select("node", "bucket", F.size("at").cast("long").alias("n"), F.col("at").alias("few"), F.lit(None).cast("binary").alias("bits"))
    return few.unionByName(dense.select("node", "bucket", "n", F.lit(None).cast("array<long>").alias("few"), "bits"))


def indexed(sets: DataFrame, forest: Forest) -> DataFrame:
    """Containers with the pre-order numbers of their nodes, written in this order: a subtree is a range that Parquet's own ranges prune to."""
    placed = sets.join(forest.nodes.select("node", "pre"), "node")
    return materialise(placed.repartitionByRange("pre", "bucket").sortWithinPartitions("pre", "bucket"), "item-sets-by-place")


def counts(sets: DataFrame) -> DataFrame:
    """``node, n``: different items of each node."""
    return sets.groupBy("node").agg(F.sum("n").alias("n"))


def _union(sets: DataFrame, by: list[str]) -> DataFrame:
    """``by, bits``: the union of all containers of a key."""
    few = sets.where("few is not null").select(*by, F.explode("few").alias("p")).groupBy(*by).agg(F.bitmap_construct_agg("p").alias("bits"))
    return few.unionByName(sets.where("bits is not null").select(*by, "bits")).groupBy(*by).agg(F.bitmap_or_agg("bits").alias("bits"))


def below(index: DataFrame, forest: Forest, groups: DataFrame) -> DataFrame:
    """``grp, bucket, bits``: the items at or below any of the nodes selected for a group (``grp, node``, a selection by hand of up to some thousand nodes).

    Nested and touching ranges of a group are one, so no container is read twice for it; each range is a condition that the index is pruned by.
    """
    picked = groups.distinct().join(forest.nodes, "node").select("grp", "pre", "last").collect()  # a selection by hand
    ranges: dict[object, list[list[int]]] = {}
    for r in sorted(picked, key=lambda r: (str(r["grp"]), r["pre"])):
        own = ranges.setdefault(r["grp"], [])
        if own and r["pre"] <= own[-1][1] + 1:
            own[-1][1] = max(own[-1][1], r["last"])
        else:
            own.append([r["pre"], r["last"]])
    kind = groups.schema["grp"].dataType
    out = None
    for grp, own in ranges.items():
        inside = F.lit(False)
        for low, high in own:
            inside |= F.col("pre").between(low, high)
        one = index.where(inside).select(F.lit(grp).cast(kind).alias("grp"), "bucket", "few", "bits")
        out = one if out is None else out.unionByName(one)
    return _union(index.limit(0).select(F.lit(None).cast(kind).alias("grp"), "bucket", "few", "bits") if out is None else out, ["grp", "bucket"])


def size(sets: DataFrame, *by: str) -> DataFrame:
    """``by, n``: how many items the bitmaps of a key have."""
    return sets.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias("n"))


def in_all(sets: DataFrame, need: int) -> DataFrame:
    """``bucket, bits``: the items that all of ``need`` groups have. Buckets that a group lacks drop out before any bitmap is read."""
    return sets.groupBy("bucket").agg(F.count("*").alias("groups"), F.bitmap_and_agg("bits").alias("bits")).where(F.col("groups") == need).select("bucket", "bits")


def members(sets: DataFrame, item: str = "item") -> DataFrame:
    """The items of bitmaps, one row each."""
    byte = lambda i: F.conv(F.hex(F.substr("bits", i + 1, F.lit(1))), 16, 10).cast("int")
    bits = lambda i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda j: F.bit_get(byte(i), j) == 1), lambda j: i * 8 + j)
    places = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(WIDTH // 8 - 1)), bits))
    return sets.select("bucket", F.explode(places).alias("p")).select(item_of(F.col("bucket"), F.col("p")).cast("long").alias(item))

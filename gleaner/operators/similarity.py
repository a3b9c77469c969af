"""Similarity joins: Hamming pairs by blocking, exact nearest neighbours in blocks, clusters over them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gleaner.functions.vector import dot, four_decimals, unit
from gleaner.operators.graph import connected_components
from gleaner.session import materialise


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hashes of 16 hex digits held as longs."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_text(a: Column, b: Column) -> Column:
    """Differing bits of two hex texts; 64 for different lengths. A character that is no digit counts as digit 0."""
    def digits(x: Column) -> Column:
        one = lambda i: F.substring(x, i, F.lit(1))
        return F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.when(one(i).rlike("[0-9a-fA-F]"), F.conv(one(i), 16, 10).cast("int")).otherwise(0))

    apart = F.aggregate(F.zip_with(digits(a), digits(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    return F.when(F.length(a) != F.length(b), 64).when(F.length(a) == 0, 0).otherwise(apart)


def segment_plan(threshold: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the segments of a 64-bit hash: so few that of any two hashes within ``threshold`` bits one segment differs in one bit at most."""
    n = min((threshold + 2) // 2, 64)
    base, extra = divmod(64, n)
    sizes = [base + 1] * extra + [base] * (n - extra)
    return [(sum(sizes[:i]), s) for i, s in enumerate(sizes)]


WIDE = 1 / 64  # of all pairs that may meet in segments; where more do, comparing blocks takes less
FEW_MET = 1_000_000  # pairs that meet in segments all the same
HASH_BLOCK = 8192  # hashes that are compared in one task with as many others


def hamming_pairs(df: DataFrame, threshold: int, key: str = "id", hash_col: str = "hash", within: Sequence[str] = ()) -> DataFrame:
    """``a, b, distance`` for every pair of different hashes within ``threshold`` bits (0 to 64), with the smallest key of each hash; with ``within`` only pairs
    that agree in these columns, which then come first.

    Equal hashes are one node (see ``copies``), so a group of copies costs one row. Hashes are cut into segments; each segment of one side, as it
    is and with each of its bits turned, meets the segments of the other as they are. A pair is emitted at the first segment that is near. Segments for many bits are short
    and show little (for 15 bits a quarter of all pairs meets); more than a few such hashes are written and compared in blocks, all with all.
    """
    nodes = df.where(F.col(hash_col).isNotNull()).groupBy(*within, F.col(hash_col).alias("h")).agg(F.min(key).alias("k"))
    plan = segment_plan(threshold)
    share = sum((bits + 1) / 2**bits for _, bits in plan)
    if share > WIDE:
        nodes = materialise(nodes, "hamming-nodes")
        sizes = nodes.groupBy(*within).agg(F.count("*").alias("n"))
        if share * (sizes.agg(F.sum(F.col("n").cast("double") ** 2)).first()[0] or 0) > FEW_MET:
            return _compared_pairs(nodes, sizes, threshold, within)
    mask = lambda bits: F.lit((1 << bits) - 1 if bits < 64 else -1)
    part = lambda h, at, bits: F.shiftrightunsigned(h, at).bitwiseAND(mask(bits))
    plain = nodes.select(*within, F.col("h").alias("ha"), F.col("k").alias("ka"), F.posexplode(F.array(*(part(F.col("h"), *p) for p in plan))).alias("no", "key"))
    flips = F.array(*(F.array(part(F.col("h"), at, bits), *(part(F.col("h").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), at + i)), at, bits) for i in range(bits))) for at, bits in plan))
    turned = nodes.select(*within, F.col("h").alias("hb"), F.col("k").alias("kb"), F.posexplode(flips).alias("no", "keys")).select(*within, "hb", "kb", "no", F.explode("keys").alias("key"))
    diff = F.col("ha").bitwiseXOR(F.col("hb"))
    earlier = F.lit(False)
    for no, p in enumerate(plan):
        earlier |= (F.lit(no) < F.col("no")) & (F.bit_count(part(diff, *p)) <= 1)
    met = plain.hint("merge").join(turned.hint("merge"), [*within, "no", "key"])  # Spark sizes them as the nodes, so it would broadcast what they are exploded to
    met = met.where((F.col("ha") < F.col("hb")) & (F.bit_count(diff) <= threshold) & ~earlier)
    return met.select(*within, F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), F.bit_count(diff).alias("distance"))


def _compared_pairs(nodes: DataFrame, sizes: DataFrame, threshold: int, within: Sequence[str]) -> DataFrame:
    """``*within, a, b, distance`` by comparing the hashes of ``*within, h, k`` (each once) in pairs of blocks; ``sizes``: ``*within, n``."""
    blocks = sizes.select(*within, F.ceil(F.col("n") / HASH_BLOCK).alias("blocks"))
    dealt = (nodes.join(blocks, [*within]) if within else nodes.crossJoin(blocks)).withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")))
    dealt = dealt.select(*within, "h", "k", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select(*within, "h", "k", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    columns = [f"b{i}" for i in range(len(within))]
    kinds = [dict(nodes.dtypes)[c] for c in within]

    def compare(part: pa.Table) -> pa.Table:
        h, block, low, high = (part.column(c).to_numpy() for c in ("h", "block", "low", "high"))
        h, (left, right) = h.view(np.uint64), (np.flatnonzero(block == side[0]) for side in (low, high))
        found = [(left[:0], left[:0], np.zeros(0, np.uint8))]
        for at in range(0, len(left), SLICE):
            rows = left[at : at + SLICE]
            others = right[at:] if low[0] == high[0] else right  # of one block each pair once
            apart = np.bitwise_count(h[rows][:, None] ^ h[others])
            i, j = np.nonzero(apart <= threshold)
            once = others[j] > rows[i] if low[0] == high[0] else np.ones(len(i), bool)
            found.append((rows[i[once]], others[j[once]], apart[i[once], j[once]]))
        one, two, bits = (np.concatenate(x) for x in zip(*found, strict=True))
        same = [part.column(c).take(pa.array(one)) for c in within]
        return pa.table([*same, part.column("k").take(pa.array(one)), part.column("k").take(pa.array(two)), pa.array(bits.astype(np.int32))], names=[*columns, "x", "y", "distance"])

    of_key = dict(nodes.dtypes)["k"]
    schema = ", ".join([*(f"{c} {t}" for c, t in zip(columns, kinds, strict=True)), f"x {of_key}", f"y {of_key}", "distance int"])
    near = dealt.groupBy(*within, "low", "high").applyInArrow(compare, schema)
    return near.select(*(F.col(c).alias(w) for c, w in zip(columns, within, strict=True)), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def copies(df: DataFrame, key: str = "id", hash_col: str = "hash") -> DataFrame:
    """``a, b`` for rows of equal hash: a star around the smallest key, not all pairs. Combined map-side before any key meets its copies."""
    low = df.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.min(key).alias("a"))
    return df.join(low, hash_col).where(F.col(key) != F.col("a")).select("a", F.col(key).alias("b"))


def hamming_groups(df: DataFrame, threshold: int, key: str = "id", hash_col: str = "hash") -> DataFrame:
    """``node, component`` over equal and near hashes; rows that are alone do not appear."""
    edges = hamming_pairs(df, threshold, key, hash_col).select("a", "b").union(copies(df, key, hash_col))
    return connected_components(materialise(edges, "hamming-edges"))


class QueryBlock(NamedTuple):
    """Queries of one length, for cosines as unit vectors, and for each list number the queries that are sent to it (None: all to all).

    ``l2``: similarity is that of unit vectors by their squared distance, not below 0, in place of the cosine.
    """

    ids: np.ndarray
    vectors: np.ndarray
    lists: dict[int, np.ndarray] | None
    l2: bool = False


BLOCK = 16_384  # queries that are sent to the tasks at once: 8 MB at 64 dimensions
SLICE = 512


def _best_rows(query: np.ndarray, item: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's ``k`` highest scores, ties to the smaller item."""
    order = np.lexsort((item, -score, query))
    q = query[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))[: len(q)]
    return order[np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k]


def nearest_batches(held, k: int, least: float):
    """Over batches of ``id, v, d`` (and ``list``): each query's ``k`` best of the task's rows. Queries come to the rows; rows are never copied."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        width = block.vectors.shape[1]
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # place of the query, item, similarity
        for batch in batches:
            rows = batch.filter(pc.equal(batch.column("d"), width))
            if not rows.num_rows or not len(block.ids):
                continue
            ids = rows.column("id").to_numpy()
            x = np.asarray(rows.column("v").flatten(), np.float64).reshape(-1, width)
            size = np.ones(len(x)) if block.l2 else np.linalg.norm(x, axis=1)
            order = np.flatnonzero(size > 0)
            order = order[np.argsort(ids[order], kind="stable")]
            groups = [(None, order)]
            if block.lists is not None:
                numbers = rows.column("list").to_numpy()[order]
                groups = [(block.lists.get(int(n)), order[numbers == n]) for n in np.unique(numbers)]
            parts = [kept]
            for sent, own in groups:
                if sent is None and block.lists is not None:
                    continue
                unit_rows, own_ids = x[own] / size[own, None], ids[own]
                asked = np.arange(len(block.ids)) if sent is None else sent
                for a in range(0, len(asked), SLICE):
                    q = asked[a : a + SLICE]
                    s = block.vectors[q] @ unit_rows.T
                    if block.l2:
                        s = np.maximum(0, 1 - ((block.vectors[q] ** 2).sum(1)[:, None] + (unit_rows**2).sum(1) - 2 * s) / 2)
                    s = np.floor(s * 10000 + 0.5) / 10000
                    s[(own_ids[None, :] == block.ids[q, None]) | (s < least)] = -np.inf
                    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    value = np.take_along_axis(s, top, 1)
                    i, j = np.nonzero(np.isfinite(value))
                    parts.append([q[i], own_ids[top[i, j]], value[i, j]])
            kept = [np.concatenate(p) for p in zip(*parts, strict=True)]
            if len(kept[0]) > 4 * k * len(block.ids):
                best = _best_rows(*kept, k)
                kept = [c[best] for c in kept]
        best = _best_rows(*kept, k)
        yield pa.RecordBatch.from_arrays([pa.array(block.ids[kept[0][best]], pa.int64()), pa.array(kept[1][best], pa.int64()), pa.array(kept[2][best], pa.float64())], ["query", "item", "similarity"])

    return run


def vectors_of(df: DataFrame, key: str = "id", vector: str = "v", *more: str) -> DataFrame:
    """``id, v, d``: vectors as floats with their length; null vectors and such with a null inside are left out."""
    sound = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    return df.where(sound).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("float")).alias("v"), F.size(vector).alias("d"), *more)


def query_blocks(queries: DataFrame, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries (``id, v, d``), in blocks of about ``block`` queries of one length that the driver holds one at a time."""
    sizes = queries.groupBy("d").agg(F.count("*").alias("n")).orderBy("d").collect()  # a row for each length
    for d, n in ((r["d"], r["n"]) for r in sizes if r["d"] > 0):
        parts = -(-n // block)
        for part in range(parts):
            own = queries.where((F.col("d") == d) & (F.pmod(F.xxhash64("id"), F.lit(parts)) == part)).select("id", "v").toArrow()
            yield own.column("id").to_numpy(), np.asarray(own.column("v").combine_chunks().flatten(), np.float64).reshape(-1, d)


def units(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors without those of length zero, the others of length one."""
    size = np.linalg.norm(x, axis=1)
    return ids[size > 0], x[size > 0] / size[size > 0, None]


def best_of(near: DataFrame, k: int) -> DataFrame:
    """``query, item, similarity, rank``: each query's ``k`` best of what the tasks have kept."""
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "item"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


NEAR = "query long, item long, similarity double"


def knn(queries: DataFrame, items: DataFrame, k: int, key: str = "id", vector: str = "v", least: float = -1.0, block: int = BLOCK, l2: bool = False) -> DataFrame:
    """``query, item, similarity, rank``: exact neighbours of every query among ``items``, itself not, by cosine or by squared distance (``l2``).

    Blocks of queries, bounded in size, are sent to all tasks; a block is one scan of the items, which are neither copied nor shuffled, and each task keeps
    its own ``k`` best for each query. Similarities are to four decimals; ties go to the smaller key. Vectors of another length than the query's, null vectors and,
    for cosines, zero vectors are no neighbours and have none. Queries are gathered when this is called; repeated queries have one list.
    """
    q, x = materialise(vectors_of(queries, key, vector).dropDuplicates(["id"]), "knn-queries"), vectors_of(items, key, vector)
    spark, out = queries.sparkSession, None
    for ids, vectors in query_blocks(q, block):
        held = spark.sparkContext.broadcast(QueryBlock(ids, vectors, None, True) if l2 else QueryBlock(*units(ids, vectors), None))
        near = x.mapInArrow(nearest_batches(held, k, least), NEAR)
        out = near if out is None else out.unionByName(near)
    return best_of(spark.createDataFrame([], NEAR) if out is None else out, k)


def mutual(neighbours: DataFrame) -> DataFrame:
    """``a, b, similarity``: pairs that are in each other's lists, once."""
    back = neighbours.select(F.col("item").alias("query"), F.col("query").alias("item"))
    both = neighbours.join(back, ["query", "item"], "left_semi").where("query < item")
    return both.select(F.col("query").alias("a"), F.col("item").alias("b"), "similarity")


def centroids(df: DataFrame, group: str, vector: str = "v", least: int = 3) -> DataFrame:
    """``group, n, centroid``: unit means of the vectors of each group with ``least`` rows or more.

    Sums are combined map-side for each component, so no group is gathered. Vectors of another length than the group's most frequent one are left out.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(group).alias("grp"), F.col(vector).alias("v"), F.size(vector).alias("d"))
    sizes = rows.groupBy("grp", "d").agg(F.count("*").alias("n"))
    main = sizes.groupBy("grp").agg(F.max_by(F.struct("d", "n"), F.struct("n", "d")).alias("m")).select("grp", "m.d", "m.n").where(F.col("n") >= least)
    sums = rows.select("grp", "d", F.posexplode("v").alias("i", "x")).groupBy("grp", "d", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = sums.join(main, ["grp", "d"]).groupBy("grp", "n").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("c"))
    values = F.transform("c", lambda s: s["x"])
    size = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x))
    return whole.select(F.col("grp").alias(group), "n", F.transform(values, lambda x: x / size).alias("centroid"))


def medoids(df: DataFrame, group: str, key: str = "id", vector: str = "v") -> DataFrame:
    """``group, n, medoid, mean_similarity``: the member of the highest mean cosine to the others (ties: smaller key), and the mean over all pairs.

    Neither needs the pairs: a member's sum of cosines is the product of its unit vector with the sum of all, less one. Only component sums meet
    by group. Rows without a vector or with a zero one are left out; one member alone has a null mean. Vectors of a group have one length.
    """
    rows = df.select(F.col(group).alias("g"), F.col(key).alias("k"), unit(F.col(vector)).alias("u")).where("u is not null")
    parts = rows.select("g", F.posexplode("u").alias("i", "x")).groupBy("g", "i").agg(F.sum("x").alias("x"))
    total = parts.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("t"))
    each = rows.join(total, "g").select("g", "k", (dot(F.col("u"), F.col("t")) - 1).alias("s"))
    out = each.groupBy("g").agg(F.count("*").alias("n"), F.max_by("k", F.struct(F.round("s", 9).alias("r"), (-F.col("k")).alias("o"))).alias("medoid"), F.sum("s").alias("s"))
    mean = F.when(F.col("n") > 1, four_decimals(F.col("s") / (F.col("n") * (F.col("n") - 1))))
    return out.select(F.col("g").alias(group), "n", "medoid", mean.alias("mean_similarity"))


def split_large(edges: DataFrame, largest: int = 60, step: float = 0.02, top: float = 0.995, start: float = 0.85, depth: int = 6) -> DataFrame:
    """``node, component`` over ``a, b, similarity`` edges; components beyond ``largest`` are split again at a higher threshold.

    Each of at most ``depth`` rounds is one distributed components job over the edges of all large components together.
    Nodes that a higher threshold cuts off are components of their own.
    """
    found, level, rest, rounds = None, start, edges.where(F.col("similarity") >= start), 0
    while True:
        parts = materialise(connected_components(materialise(rest, "split-edges")), "split-parts")
        sizes = parts.groupBy("component").agg(F.count("*").alias("n"))
        level, rounds = level + step, rounds + 1
        last = level > top or rounds > depth
        big = sizes.where(F.lit(not last) & (F.col("n") > largest)).select("component")
        done = parts.join(F.broadcast(big) if last else big, "component", "left_anti").select("node", "component")
        found = done if found is None else found.union(done)
        if last or not big.head(1):
            return found
        members = parts.join(big, "component", "left_semi").select("node")
        rest = rest.join(members.withColumnRenamed("node", "a"), "a", "left_semi").where(F.col("similarity") >= level)
        linked = rest.select(F.col("a").alias("node")).union(rest.select(F.col("b").alias("node"))).distinct()
        alone = members.join(linked, "node", "left_anti")
        found = found.union(alone.select("node", F.col("node").alias("component")))

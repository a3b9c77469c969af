"""Exact top-k inner products with a KD-tree for each shard.

Rows are dealt evenly to shards of bounded size. A shard's tree splits at medians of its
widest component and keeps the tight box of every node and the smallest id in it. A block
of queries goes down the tree level by level with the largest inner product that a box
allows, then visits the leaves best first; whatever cannot beat a query's kth result is left
out. A query first meets its own shard, and the kth result found there goes with
it to all other shards, which return improvements only.

Scores are exact integers as long as they fit a long: blocks are multiplied in float32 or float64 only where every partial
sum fits the mantissa, else in int64.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from gleaner.session import materialise

LEAF = 64
SHARD_ROWS = 32_768
BLOCK_QUERIES = 8192  # queries that one task holds, at most (as blocks are dealt by hash, about)
LOWEST = -(1 << 62)  # below every score
NO_ID = np.iinfo(np.int64).max


class Tree(NamedTuple):
    """Rows in leaf order; levels of nodes as (box low, box high, smallest id, first row, last row + 1, children's parent index)."""

    x: np.ndarray
    ids: np.ndarray
    levels: list[tuple[np.ndarray, ...]]


def build(x: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> Tree:
    """Median splits until nodes hold ``leaf`` rows; all leaves are on the last level."""
    order = np.argsort(ids, kind="stable")
    bounds = np.array([0, len(ids)])
    parents, shape = [np.zeros(1, np.int64)], [bounds]
    while np.diff(bounds).max() > leaf:
        cuts, parent = [0], []
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if b - a > 1:
                own = x[order[a:b]]
                widest = int((own.max(0) - own.min(0)).argmax())
                order[a:b] = order[a:b][np.argsort(own[:, widest], kind="stable")]
                cuts.append((a + b) // 2)
                parent.append(i)
            cuts.append(b)
            parent.append(i)
        bounds = np.array(cuts)
        parents.append(np.array(parent))
        shape.append(bounds)
    x, ids = np.ascontiguousarray(x[order]), ids[order]
    levels = []
    for bounds, parent in zip(shape, parents, strict=True):
        first = bounds[:-1]
        levels.append((np.minimum.reduceat(x, first, 0), np.maximum.reduceat(x, first, 0), np.minimum.reduceat(ids, first), first, bounds[1:], parent))
    return Tree(x, ids, levels)


def _exact(*parts: np.ndarray) -> type:
    """The fastest number type in which inner products of these integers are exact."""
    top = [max(float(np.abs(p.astype(np.float64)).max(initial=0)), 1.0) for p in parts]
    size = parts[0].shape[1] * top[0] * top[1]
    return np.float32 if size < 1 << 24 else np.float64 if size < 1 << 53 else np.int64


def search(tree: Tree, q: np.ndarray, own: np.ndarray, k: int, kth: np.ndarray, kth_id: np.ndarray, counts: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row id, score) of up to ``k`` rows for each query that beat (``kth``, ``kth_id``): a higher score, or the same and a smaller id.

    Rows whose id is the query's ``own`` are no results. ``counts`` takes up how many boxes were evaluated, of all.
    """
    kind = _exact(q, tree.x)
    x, fq = tree.x.astype(kind), q.astype(kind)
    up, down = np.maximum(fq, 0), np.minimum(fq, 0)
    kth, kth_id = kth.copy(), kth_id.copy()
    active, met = np.ones((len(q), 1), bool), 0
    for low, high, least, _, _, parent in tree.levels:
        bound, now = np.full((len(q), len(parent)), LOWEST), np.zeros((len(q), len(parent)), bool)
        low, high = low.astype(kind), high.astype(kind)
        edges = np.searchsorted(parent, np.arange(active.shape[1] + 1))
        for node in np.flatnonzero(active.any(0)):  # only the boxes below a node that a query still has to look into
            rows, kids = np.flatnonzero(active[:, node]), slice(int(edges[node]), int(edges[node + 1]))
            top = (up[rows] @ high[kids].T + down[rows] @ low[kids].T).astype(np.int64)
            bound[rows, kids] = top
            now[rows, kids] = (top > kth[rows, None]) | ((top == kth[rows, None]) & (least[None, kids] < kth_id[rows, None]))
            met += top.size
        active = now
    if counts is not None:
        counts["boxes"] = counts.get("boxes", 0) + met
        counts["all boxes"] = counts.get("all boxes", 0) + len(q) * sum(len(level[-1]) for level in tree.levels)
    _, _, least, first, last, _ = tree.levels[-1]
    bound[~active] = LOWEST
    order = np.argsort(-bound, axis=1, kind="stable")
    ranked = np.take_along_axis(bound, order, 1)
    top = np.full((len(q), k), LOWEST)
    top_id = np.full((len(q), k), NO_ID)
    limit, limit_id = kth, kth_id
    at, width = 0, 1
    while at < order.shape[1]:
        own_bound, leaf = ranked[:, at : at + width], order[:, at : at + width]
        go = (own_bound > LOWEST) & ((own_bound > limit[:, None]) | ((own_bound == limit[:, None]) & (least[leaf] < limit_id[:, None])))
        if not (ranked[:, at] > LOWEST).any() or not (ranked[:, at] >= limit).any():
            break
        query, column = np.nonzero(go)
        leaves = leaf[query, column]
        by = np.argsort(leaves, kind="stable")
        cuts = np.flatnonzero(np.diff(leaves[by], prepend=-1) > 0)
        found = []
        for a, b in zip(cuts, np.append(cuts, len(by))[1:], strict=True):
            node, members = leaves[by[a]], query[by[a:b]]
            s, e = first[node], last[node]
            score = (fq[members] @ x[s:e].T).astype(np.int64)
            ids = tree.ids[s:e]
            better = (score > limit[members, None]) | ((score == limit[members, None]) & (ids[None, :] < limit_id[members, None]))
            better &= ids[None, :] != own[members, None]
            i, j = np.nonzero(better)
            found.append((members[i], ids[j], score[i, j]))
        if found:
            fq_, fi, fs = (np.concatenate(z) for z in zip(*found, strict=True))
            held = np.repeat(np.arange(len(q)), k)
            fq_, fi, fs = np.concatenate([fq_, held]), np.concatenate([fi, top_id.ravel()]), np.concatenate([fs, top.ravel()])
            sort = np.lexsort((fi, -fs, fq_))
            fq_, fi, fs = fq_[sort], fi[sort], fs[sort]
            begin = np.searchsorted(fq_, np.arange(len(q)))
            pick = begin[:, None] + np.arange(k)
            top, top_id = fs[pick], fi[pick]
            more = (top[:, -1] > limit) | ((top[:, -1] == limit) & (top_id[:, -1] < limit_id))
            limit, limit_id = np.where(more, top[:, -1], limit), np.where(more, top_id[:, -1], limit_id)
        at += width
        width = min(2 * width, 64)
    i, j = np.nonzero(top > LOWEST)
    return i, top_id[i, j], top[i, j]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten()).reshape(len(flat), -1)


def _task(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        if rows.num_rows and queries.num_rows:
            tree = build(_matrix(rows.column("v")), rows.column("id").to_numpy())
            qid, key = queries.column("id").to_numpy(), queries.column("key").to_numpy()
            q = _matrix(queries.column("v"))
            kth = queries.column("kth").to_numpy()
            kth_id = queries.column("kth_id").to_numpy()
            for a in range(0, len(qid), 1024):
                s = slice(a, a + 1024)
                i, found, score = search(tree, q[s], qid[s], k, kth[s], kth_id[s])
                for part, own in zip(out, (qid[s][i], key[s][i], found, score), strict=True):
                    part.append(own)
        columns = [pa.array(np.concatenate(p) if p else np.zeros(0, np.int64), pa.int64()) for p in out]
        return pa.table(columns, names=["query_id", "key", "vec_id", "score"])

    return run


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``id, v``: components as floor(scale * x). Rows without an id, without components, or with a null or non-finite component are left out."""
    x = df[vector_col]
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return df.where(df[id_col].isNotNull() & (F.size(x) > 0) & ~bad).select(
        df[id_col].cast("long").alias("id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("v")
    )


def top_k(df: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every query row the ``k`` rows of highest inner product, ties to the smaller id.

    ``is_query`` is a condition on ``id``. Rows of the query's own id are no candidates; vectors of another length are
    none either. Repeated rows are candidates each; a repeated query counts once, and one id with different
    vectors is a query for each of them. Fewer candidates than ``k`` give fewer rows. An empty table gives an empty result.
    """
    rows = materialise(vectors(df, id_col, vector_col).withColumn("d", F.size("v")).withColumn("r", F.rand(5)), "kdtree-rows")
    n = rows.count()
    shards = max(16 if n > 1000 else 1, -(-n // shard_rows))
    placed = rows.withColumn("shard", F.floor(F.col("r") * shards).cast("int"))
    queries = placed.where(is_query).withColumn("key", F.xxhash64("id", "v")).dropDuplicates(["id", "key"]).select("id", "key", "v", "d", "shard")
    queries = materialise(queries, "kdtree-queries")
    blocks = max(1, -(-queries.count() // block_queries))
    queries = queries.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(blocks)).cast("int"))
    every = placed.select("id", "v", "d", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    by = ["d", "shard", "block"]
    schema = "query_id long, key long, vec_id long, score long"

    def met(asked: DataFrame) -> DataFrame:
        return every.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(_task(k), schema)

    none = queries.withColumn("kth", F.lit(LOWEST)).withColumn("kth_id", F.lit(NO_ID))
    home = materialise(met(none.select("id", "key", "v", *by, "kth", "kth_id")), "kdtree-home")
    rank = F.row_number().over(W.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    last = home.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("id"), "key", F.col("score").alias("kth"), F.col("vec_id").alias("kth_id"))
    bounded = queries.join(last, ["id", "key"], "left").select(
        "id", "key", "v", "d", "block", F.col("shard").alias("home"), F.coalesce("kth", F.lit(LOWEST)).alias("kth"), F.coalesce("kth_id", F.lit(NO_ID)).alias("kth_id")
    )
    away = bounded.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home").drop("home")
    found = home.unionByName(met(away)) if shards > 1 else home
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Trees as adjacency lists: pre-order intervals, subtree counts and sums, closures, expansion of filters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gleaner.operators.order import running, running_by_place
from gleaner.session import materialise


HOPS = 4  # levels that one job goes down


def closure(tree: DataFrame, node: str = "id", parent: str = "parent_id", parents_only: bool = False, roots: DataFrame | None = None) -> DataFrame:
    """``ancestor, node``: every node with itself and all nodes below it; with ``roots`` (``node``), only those below one of them.

    From roots, each job goes ``HOPS`` levels down from the pairs that the one before it found last, and writes what is new; without, paths double in
    length each round. A pair is kept once: cycles end by themselves, and each node of a cycle is below all others. ``parents_only`` leaves out the pairs of
    nodes with nothing below them (without roots).
    """
    if roots is None:
        return _doubled(tree, node, parent, parents_only)
    edges = tree.where(F.col(parent).isNotNull()).select(F.col(parent).alias("up"), F.col(node).alias("down")).distinct()
    edges = materialise(edges, "closure-edges")
    own = tree.select(F.col(node).alias("ancestor"), F.col(node).alias("node"))
    picked = roots.select(F.col("node").alias("ancestor")).distinct()
    known = own = own.join(picked, "ancestor", "left_semi")
    step = materialise(picked.select("ancestor", F.col("ancestor").alias("node")), "closure-roots")
    while True:
        found = None
        for hop in range(1, HOPS + 1):
            step = step.join(edges, step["node"] == edges["up"]).select("ancestor", F.col("down").alias("node")).distinct()
            at = step.withColumn("hop", F.lit(hop))
            found = at if found is None else found.unionByName(at)
        fresh = found.groupBy("ancestor", "node").agg(F.max("hop").alias("hop")).join(known, ["ancestor", "node"], "left_anti")
        fresh = materialise(fresh, "closure")
        known = known.unionByName(fresh.select("ancestor", "node"))
        step = fresh.where(F.col("hop") == HOPS).select("ancestor", "node")
        if step.isEmpty():
            return known.unionByName(own).distinct()


def _doubled(tree: DataFrame, node: str, parent: str, parents_only: bool) -> DataFrame:
    edges = tree.where(F.col(parent).isNotNull()).select(F.col(parent).alias("ancestor"), F.col(node).alias("node")).distinct()
    known, n = materialise(edges, "closure"), -1
    while n != (m := known.count()):
        n = m
        longer = known.alias("a").join(known.alias("b"), F.col("a.node") == F.col("b.ancestor")).select("a.ancestor", "b.node")
        known = materialise(known.union(longer).distinct(), "closure")
    own = tree.select(F.col(node).alias("ancestor"), F.col(node).alias("node"))
    if parents_only:
        own = own.join(edges.select("ancestor"), "ancestor", "left_semi")
    return known.union(own).distinct()


class Forest(NamedTuple):
    """Nodes with pre-order numbers: a node's subtree is what has numbers from ``pre`` to ``last``.

    ``nodes``: ``node, parent, pre, last, depth`` and for the ancestor 1, 2, 4, ... levels up (``levels`` of them) its ``pre`` and ``last`` as ``up0, end0, up1, end1, ...``.
    ``looped``: ``node, parent`` of the nodes on cycles and below them, which have no numbers; None if there are none.
    """

    nodes: DataFrame
    levels: int
    looped: DataFrame | None


JUMPS = 2  # doublings that one job makes


SMALL = 1 << 18  # nodes of a tree that one task numbers (some 50 MB there); larger ones are numbered by joins


def _rows(tree: DataFrame, node: str, parent: str, **sums: Column) -> DataFrame:
    """``node, parent, several`` and the sums, one row a node, written: its smallest parent, and whether it has another."""
    rows = tree.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(parent).alias("parent"), F.max(parent).alias("other"), *(F.sum(c).alias(n) for n, c in sums.items()))
    return materialise(rows.select("node", "parent", (F.col("parent") != F.col("other")).alias("several"), *sums), "tree")


def _edges(rows: DataFrame, *sums: str) -> DataFrame:
    """``node, up0, depth, several`` and the sums: the parent if that is a node, and 1 if there is one."""
    known = rows.join(rows.select(F.col("node").alias("have")), F.col("parent") == F.col("have"), "left")
    return materialise(known.select("node", F.col("have").alias("up0"), F.when(F.col("have").isNull(), 0).otherwise(1).cast("long").alias("depth"), "several", *sums), "forest-edges")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number a whole small tree: ``node, parent`` rows to numbers, ancestors by doubling levels, -1 as the number of what is on cycles and below them."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    table = table.take(pc.sort_indices(table.column("node")))
    nodes = table.column("node").combine_chunks()
    up = pc.fill_null(pc.index_in(table.column("parent").combine_chunks(), nodes, skip_nulls=True), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    n, ups, depth = len(up), [up], (up >= 0).astype(np.int64)
    while (ups[-1] >= 0).any() and 1 << len(ups) <= 2 * n:
        last = ups[-1]
        depth = depth + np.where(last >= 0, depth[last], 0)
        ups.append(np.where(last >= 0, last[last], -1))
    looped = ups[-1] >= 0
    size, offset, pre = np.ones(n, np.int64), np.zeros(n, np.int64), np.full(n, -1)
    by_depth = np.argsort(np.where(looped, -1, depth), kind="stable")
    by_depth = by_depth[int(looped.sum()) :]
    levels = np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1) if len(by_depth) else []
    for own in reversed(levels[1:]):
        np.add.at(size, up[own], size[own])
    free = np.flatnonzero(~looped)
    order = free[np.argsort(up[free], kind="stable")]
    before = np.cumsum(size[order]) - size[order]
    first = np.concatenate([[True], np.diff(up[order]) != 0]) if len(order) else np.zeros(0, bool)
    base = before[first][np.cumsum(first) - 1] if len(order) else before
    offset[order] = before - base + (up[order] >= 0)
    for i, own in enumerate(levels):
        pre[own] = offset[own] + (pre[up[own]] if i else 0)
    last = pre + size - 1
    pick = lambda values, at: pa.array(np.where(at >= 0, values[at], 0), mask=at < 0)
    kept = ups[: max(1, len(ups) - 1)] if not looped.any() else ups
    stacked = lambda values: pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(kept) + 1, len(kept), dtype=np.int32)), pick(values, np.stack(kept, 1).ravel()))
    columns = [nodes, nodes.take(pa.array(up, mask=up < 0)), pa.array(np.where(looped, -1, pre)), pa.array(last), pa.array(depth), stacked(pre), stacked(last)]
    yield pa.RecordBatch.from_arrays(columns, ["node", "parent", "pre", "last", "depth", "ups", "ends"])


def _small_forest(rows: DataFrame) -> Forest:
    kind = rows.schema["node"].dataType.simpleString()
    found = rows.select("node", F.col("parent").cast(kind).alias("parent")).coalesce(1).mapInArrow(_numbered, f"node {kind}, parent {kind}, pre long, last long, depth long, ups array<long>, ends array<long>")
    found = materialise(found, "forest-nodes")
    seen = found.agg(F.max(F.size("ups")).alias("levels"), F.min("pre").alias("low")).first()
    levels = seen["levels"] or 1
    ups = [F.get(c, F.lit(k)).alias(f"{n}{k}") for k in range(levels) for c, n in (("ups", "up"), ("ends", "end"))]
    nodes = found.where("pre >= 0").select("node", "parent", "pre", "last", "depth", *ups)
    return Forest(nodes, levels, found.where("pre < 0").select("node", "parent") if seen["low"] == -1 else None)


def _doubled_up(t: DataFrame, sums: Sequence[str]) -> tuple[DataFrame, int, DataFrame | None] | None:
    """Ancestors 1, 2, 4, ... levels up as ``up0, up1, ...``, depths, and in place of each of ``sums`` its sum over the subtree, in logarithmically many rounds; None
    if a node has several parents.

    A node at distance below 2**k adds to a sum once: round k adds to each node the sums so far of the nodes 2**k below it. A round that leaves as many
    nodes with an ancestor that far up as the one before leaves only nodes on cycles and below them. ``t``: what ``_edges`` gives.
    """
    k = 0
    while True:
        for _ in range(JUMPS):
            ups = [f"up{i}" for i in range(k + 1)]
            more = t.where(F.col(f"up{k}").isNotNull()).groupBy(F.col(f"up{k}").alias("to")).agg(*(F.sum(c).alias(f"more_{c}") for c in sums))
            far = t.select(F.col("node").alias("far"), F.col(f"up{k}").alias("next"), F.col("depth").alias("far_depth"))
            wide = t.join(far, t[f"up{k}"] == far["far"], "left").join(more, F.col("node") == F.col("to"), "left")
            grown = [(F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))).alias(c) for c in sums]
            t = wide.select("node", *ups, F.col("next").alias(f"up{k + 1}"), (F.col("depth") + F.coalesce("far_depth", F.lit(0))).alias("depth"), "several", *grown)
            k += 1
        t = materialise(t, "forest")
        left = t.agg(F.count(f"up{k}").alias("now"), F.count(f"up{k - 1}").alias("before"), F.bool_or("several").alias("several")).first()
        if left["several"]:
            return None
        if left["now"] == 0:
            return t, k, None
        if left["now"] == left["before"]:
            last = F.col(f"up{k}")
            return t.where(last.isNull()), k, t.where(last.isNotNull()).select("node", F.col("up0").alias("parent"))


def forest(tree: DataFrame, node: str = "id", parent: str = "parent_id") -> Forest | None:
    """Pre-order numbers for a tree given by parents, or None if a node has several parents.

    Siblings go by their ids. A parent that is no node counts as none. Subtree sizes come from doubled ancestors; a child's number is its parent's, plus one,
    plus the sizes of the siblings before it, again summed over doubled ancestors. Nothing grows with the number of pairs of ancestor and node. A tree of up to ``SMALL`` nodes
    is numbered in the same way by one task, without joins.
    """
    rows = _rows(tree, node, parent)
    checked = rows.agg(F.count("*").alias("n"), F.bool_or("several").alias("several")).first()
    if checked["several"]:
        return None
    if checked["n"] <= SMALL:
        return _small_forest(rows)
    t, levels, looped = _doubled_up(_edges(rows.withColumn("size", F.lit(1).cast("long")), "size"), ["size"])
    ups = [f"up{i}" for i in range(levels)]
    placed = running(t, ["up0", "node"], "size", "upto").withColumn("upto", F.col("upto") - F.col("size"))
    base = placed.groupBy(F.col("up0").alias("p")).agg(F.min("upto").alias("base"))
    placed = placed.join(base, placed["up0"].eqNullSafe(base["p"]), "left")
    own = F.col("upto") - F.col("base") + F.when(F.col("up0").isNull(), 0).otherwise(1)
    t = placed.select("node", *ups, "depth", "size", own.alias("pre"))
    for k in range(levels):
        if k % JUMPS == 0:
            t = materialise(t, "forest-pre")
        far = t.select(F.col("node").alias("far"), F.col("pre").alias("more"))
        t = t.join(far, t[f"up{k}"] == far["far"], "left").select("node", *ups, "depth", "size", (F.col("pre") + F.coalesce("more", F.lit(0))).alias("pre"))
    t = materialise(t, "forest-numbers")
    nodes = t.select("node", F.col("up0").alias("parent"), "pre", (F.col("pre") + F.col("size") - 1).alias("last"), "depth", *(F.col(c).alias(f"n{c}") for c in ups))
    for k in range(levels):
        far = t.select(F.col("node").alias("far"), F.col("pre").alias(f"up{k}"), (F.col("pre") + F.col("size") - 1).alias(f"end{k}"))
        nodes = nodes.join(far, nodes[f"nup{k}"] == far["far"], "left").drop("far", f"nup{k}")
    return Forest(materialise(nodes, "forest-nodes"), levels, looped)


def roll_up(forest: Forest, values: DataFrame) -> DataFrame:
    """``node, total``: for every numbered node the sum of ``pre, v`` over its subtree, as the difference of two running sums. ``pre``: a node's number."""
    own = values.groupBy(F.col("pre").alias("p")).agg(F.sum("v").alias("v"))
    nodes = forest.nodes.select("node", "pre", "last")
    rows = materialise(nodes.join(own, nodes["pre"] == own["p"], "left").select("node", "pre", "last", F.coalesce("v", F.lit(0)).alias("v")), "roll-up")
    sums = running_by_place(rows, "pre", "v", "upto")
    ends = sums.select(F.col("pre").alias("end"), F.col("upto").alias("at_end"))
    return sums.join(ends, sums["last"] == ends["end"]).select("node", (F.col("at_end") - F.col("upto") + F.col("v")).alias("total"))


def meeting(forest: Forest, pairs: DataFrame) -> DataFrame:
    """``pairs`` of numbers (``a, b`` and others; ``a`` below ``b``) with ``meet``, the number of the deepest node that both are at or below; pairs of different trees are left out.

    Steps of halving length go up from ``a`` as long as ``b`` is outside.
    """
    x = pairs.withColumn("at", F.col("a"))
    for k in reversed(range(forest.levels)):
        step = forest.nodes.select(F.col("pre").alias("from"), F.col("last").alias("own_end"), F.col(f"up{k}").alias("to"), F.col(f"end{k}").alias("end"))
        x = x.join(step, F.col("at") == F.col("from"))
        x = x.withColumn("at", F.when((F.col("own_end") < F.col("b")) & (F.col("end") < F.col("b")), F.col("to")).otherwise(F.col("at"))).drop("from", "own_end", "to", "end")
    top = forest.nodes.select(F.col("pre").alias("from"), F.col("last").alias("own_end"), F.col("up0").alias("to"))
    x = x.join(top, F.col("at") == F.col("from")).withColumn("meet", F.when(F.col("own_end") >= F.col("b"), F.col("at")).otherwise(F.col("to")))
    return x.where("meet is not null").drop("from", "own_end", "to", "at")


def subtree_distinct(tree: DataFrame, links: DataFrame, item: str, node: str = "id", parent: str = "parent_id", link_node: str = "node") -> DataFrame:
    """``node, n``: distinct items over each node's subtree, 0 where there are none.

    An item counts one at each of its nodes and minus one where two of its nodes that follow each other in pre-order meet: over any subtree that is one
    if the item has a node there. So links are read once and never spread over their ancestors. Nodes on cycles and below them, and trees in which a
    node has several parents, go by closures.
    """
    f = forest(tree, node, parent)
    if f is None:
        return _distinct_by_closure(tree, links, item, node, parent, link_node)
    places = f.nodes.select(F.col("node").alias("place"), "pre")
    direct = links.where(F.col(item).isNotNull()).select(F.col(link_node).alias("place"), F.col(item).alias("item")).join(places, "place").select("item", "pre")
    steps = direct.withColumn("before", F.lag("pre").over(W.partitionBy("item").orderBy("pre"))).where("before is null or before <> pre")  # a repeated link follows itself
    steps = materialise(steps.groupBy("before", "pre").agg(F.count("*").alias("n")), "subtree-steps")
    minus = meeting(f, steps.where("before is not null").select(F.col("before").alias("a"), F.col("pre").alias("b"), "n"))
    values = steps.select("pre", F.col("n").alias("v")).unionByName(minus.select(F.col("meet").alias("pre"), (-F.col("n")).alias("v")))
    out = roll_up(f, values).select("node", F.col("total").alias("n"))
    if f.looped is not None:
        out = out.unionByName(_distinct_by_closure(f.looped, links, item, "node", "parent", link_node))
    nodes = tree.select(F.col(node).alias("node"))
    return nodes.join(out, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n"))


def _distinct_by_closure(tree: DataFrame, links: DataFrame, item: str, node: str, parent: str, link_node: str) -> DataFrame:
    """Only nodes with children take part in the closure; leaves count their own links."""
    direct = links.where(F.col(item).isNotNull()).select(F.col(link_node).alias("node"), F.col(item).alias("item")).distinct()
    over = closure(tree, node, parent, parents_only=True)
    inner = over.select("ancestor").distinct()
    deep = over.join(direct, "node").groupBy(F.col("ancestor").alias("node")).agg(F.count_distinct("item").alias("n"))
    leaf = direct.join(inner.withColumnRenamed("ancestor", "node"), "node", "left_anti").groupBy("node").agg(F.count("*").alias("n"))
    return tree.select(F.col(node).alias("node")).join(deep.union(leaf), "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n"))


def subtree_sum(tree: DataFrame, value: str, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """``node, total``: the sum of a column over each node's subtree (null counts as 0), by doubled ancestors; with cycles or several parents by closures."""
    worth = F.coalesce(F.col(value), F.lit(0))
    made = _doubled_up(_edges(_rows(tree, node, parent, v=worth), "v"), ["v"])
    own = lambda: tree.groupBy(F.col(node).alias("node")).agg(F.sum(worth).alias("v"))
    if made is None:
        return _sum_by_closure(tree.select(F.col(node).alias("node"), F.col(parent).alias("parent")), own())
    t, _, looped = made
    out = t.select("node", F.col("v").alias("total"))
    return out if looped is None else out.unionByName(_sum_by_closure(looped, own()))


def _sum_by_closure(tree: DataFrame, own: DataFrame) -> DataFrame:
    return closure(tree, "node", "parent").join(own.select("node", "v"), "node").groupBy(F.col("ancestor").alias("node")).agg(F.sum("v").alias("total"))


MAX_PICKED = 10_000  # selected nodes whose ranges are tried on each node; more go by their closure


def items_below_all(tree: DataFrame, links: DataFrame, groups: DataFrame, item: str, node: str = "id", parent: str = "parent_id", link_node: str = "node") -> DataFrame:
    """``item``: those that have, for every group of selected nodes, a link at or below one of its nodes. ``groups``: ``grp, node``.

    The selected nodes' ranges mark the nodes below them, and one pass over the links gathers the groups of each item. Selections beyond ``MAX_PICKED`` nodes,
    and trees with cycles or several parents, go by the closure of the selected nodes.
    """
    f = forest(tree, node, parent)
    picked = groups.select("grp", "node").distinct()
    if f is None or f.looped is not None or picked.limit(MAX_PICKED + 1).count() > MAX_PICKED:
        return items_in_all(links, picked, closure(tree, node, parent, roots=picked), item, link_node)
    ranges = picked.join(f.nodes, "node").select("grp", F.col("pre").alias("low"), F.col("last").alias("high"))
    need = picked.select(F.count_distinct("grp").alias("need"))
    below = f.nodes.join(F.broadcast(ranges), F.col("pre").between(F.col("low"), F.col("high"))).select(F.col("node").alias("place"), "grp").distinct()
    hit = links.select(F.col(link_node).alias("place"), F.col(item).alias("item")).join(below, "place").groupBy("item").agg(F.collect_set("grp").alias("got"))
    return hit.crossJoin(F.broadcast(need)).where(F.size("got") == F.col("need")).select(F.col("item").alias(item))


def expand(roots: DataFrame, over: DataFrame, root: str = "node") -> DataFrame:
    """Every node at or below one of the roots, once."""
    picked = roots.select(F.col(root).alias("ancestor"))
    return over.join(picked, "ancestor", "left_semi").select("node").distinct()


def items_in_all(links: DataFrame, groups: DataFrame, over: DataFrame, item: str, link_node: str = "node") -> DataFrame:
    """Items that have, for every group of selected nodes, a link at or below one of its nodes. ``groups``: ``grp, node``."""
    wide = groups.join(over, groups["node"] == over["ancestor"]).select("grp", over["node"]).distinct()
    hit = links.join(wide, links[link_node] == wide["node"]).select(item, "grp").distinct()
    need = groups.select(F.count_distinct("grp").alias("need"))
    return hit.groupBy(item).agg(F.count("*").alias("got")).crossJoin(F.broadcast(need)).where("got = need").select(item)


def visible_totals(tree: DataFrame, hidden: DataFrame, value: str, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """``node, total``: subtree sums without the hidden subtrees, for nodes that are not hidden themselves. ``hidden``: ``node``.

    With numbers, what is below a hidden node follows from how many hidden ranges are open where it stands, by one running sum. Where there are
    cycles or several parents, closures say it.
    """
    f = forest(tree, node, parent)
    if f is None or f.looped is not None:
        return _visible_by_closure(tree, hidden, value, node, parent)
    ranges = f.nodes.join(hidden.select("node").distinct(), "node", "left_semi").select(F.col("pre").alias("low"), (F.col("last") + 1).alias("high"))
    turns = ranges.select(F.col("low").alias("at"), F.lit(1).alias("d")).unionByName(ranges.select(F.col("high").alias("at"), F.lit(-1).alias("d"))).groupBy("at").agg(F.sum("d").alias("d"))
    marked = materialise(f.nodes.join(turns, f.nodes["pre"] == turns["at"], "left").select("node", "pre", F.coalesce("d", F.lit(0)).alias("d")), "hidden-turns")
    kept = running_by_place(marked, "pre", "d", "open").where("open = 0").select("node", "pre")
    own = tree.select(F.col(node).alias("node"), F.coalesce(F.col(value), F.lit(0)).alias("v")).join(kept, "node").select("pre", "v")
    return roll_up(f, own).join(kept, "node", "left_semi")


def _visible_by_closure(tree: DataFrame, hidden: DataFrame, value: str, node: str, parent: str) -> DataFrame:
    over = materialise(closure(tree, node, parent), "closure-visible")
    gone = expand(hidden, over)
    kept = tree.join(gone, tree[node] == gone["node"], "left_anti")
    own = kept.select(F.col(node).alias("node"), F.coalesce(F.col(value), F.lit(0)).alias("v"))
    sums = over.join(own, "node").groupBy("ancestor").agg(F.sum("v").alias("total"))
    return kept.select(F.col(node).alias("ancestor")).join(sums, "ancestor").select(F.col("ancestor").alias("node"), "total")

"""Trees by intervals: against walks over random forests, chains, cycles, several parents."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gleaner.operators import hierarchy


@pytest.fixture(autouse=True, params=["small", "large"])
def size(request, monkeypatch):
    """Every test for trees that one task numbers, and for such that joins do."""
    if request.param == "large":
        monkeypatch.setattr(hierarchy, "SMALL", 0)


def walk(parents):
    """Node: all nodes below it, itself included; parents that are no nodes count as none."""
    below = defaultdict(set)
    for node in parents:
        at, seen = node, set()
        while at in parents and at not in seen:
            seen.add(at)
            below[at].add(node)
            at = parents[at]
    return below


def random_parents(rng, n, wide):
    return {i: None if i == 0 or rng.random() < 0.05 else rng.randrange(max(0, i - wide), i) for i in range(n)}


def frame(spark, parents):
    return spark.createDataFrame(list(parents.items()), "id long, parent_id long")


@pytest.mark.parametrize("wide", [1, 40])
def test_numbers_are_a_pre_order(spark, wide):
    parents = random_parents(random.Random(wide), 120, wide)
    parents[200] = 999  # its parent is no node
    f = hierarchy.forest(frame(spark, parents))
    rows = {r["node"]: r for r in f.nodes.collect()}
    below = walk(parents)
    assert f.looped is None and sorted(r["pre"] for r in rows.values()) == list(range(len(parents)))
    for node, r in rows.items():
        assert {n for n, x in rows.items() if r["pre"] <= x["pre"] <= r["last"]} == below[node]
        assert r["depth"] == sum(node in b for a, b in below.items()) - 1
    children = defaultdict(list)
    for node, r in sorted(rows.items()):
        children[r["parent"]].append(r["pre"])
    assert all(c == sorted(c) for c in children.values())  # siblings by id


def links_of(rng, nodes, n):
    return [(rng.randrange(40), rng.choice(nodes)) for _ in range(n)] + [(None, nodes[0]), (1, -5), (2, None)]


def distinct(parents, links):
    below = walk(parents)
    return {node: len({i for i, t in links if t in below[node] and i is not None}) for node in parents}


@pytest.mark.parametrize("wide", [1, 40])
def test_sums_and_distinct_items(spark, wide):
    rng = random.Random(10 + wide)
    parents = random_parents(rng, 90, wide)
    links = links_of(rng, list(parents), 300)
    df = frame(spark, parents).withColumn("v", F.col("id") % 7)
    got = {r["node"]: r["n"] for r in hierarchy.subtree_distinct(df, spark.createDataFrame(links, "item long, node long"), "item").collect()}
    assert got == distinct(parents, links)
    below = walk(parents)
    sums = {r["node"]: r["total"] for r in hierarchy.subtree_sum(df, "v").collect()}
    assert sums == {n: sum(x % 7 for x in below[n]) for n in parents}
    hidden = rng.sample(list(parents), 6)
    gone = set().union(*(below[h] for h in hidden))
    seen = {r["node"]: r["total"] for r in hierarchy.visible_totals(df, spark.createDataFrame([(h,) for h in hidden], "node long"), "v").collect()}
    assert seen == {n: sum(x % 7 for x in below[n] - gone) for n in parents if n not in gone}


def test_cycles_go_by_closures(spark):
    parents = {1: None, 2: 1, 3: 2, 10: 12, 11: 10, 12: 11, 13: 12, 14: 13, 20: 20, 21: 20}
    links = [(1, 3), (2, 2), (2, 3), (5, 14), (6, 10), (6, 13), (7, 21), (7, 20), (8, 1)]
    df = frame(spark, parents).withColumn("v", F.lit(1))
    f = hierarchy.forest(df)
    assert {r["node"] for r in f.looped.collect()} == {10, 11, 12, 13, 14, 20, 21} and f.nodes.count() == 3
    got = {r["node"]: r["n"] for r in hierarchy.subtree_distinct(df, spark.createDataFrame(links, "item long, node long"), "item").collect()}
    assert got == distinct(parents, links)
    below = walk(parents)
    assert {r["node"]: r["total"] for r in hierarchy.subtree_sum(df, "v").collect()} == {n: len(below[n]) for n in parents}
    groups = spark.createDataFrame([(0, 10), (1, 13)], "grp int, node long")
    assert [r["item"] for r in hierarchy.items_below_all(df, spark.createDataFrame(links, "item long, node long"), groups, "item").orderBy("item").collect()] == [5, 6]


def test_several_parents_go_by_closures(spark):
    tree = spark.createDataFrame([(1, None, 1), (2, None, 1), (3, 1, 5), (3, 2, 0), (4, 3, 7)], "id long, parent_id long, v int")
    assert hierarchy.forest(tree) is None
    links = spark.createDataFrame([(1, 4), (1, 3), (2, 1)], "item long, node long")
    got = {(r["node"], r["n"]) for r in hierarchy.subtree_distinct(tree, links, "item").collect()}
    assert got == {(1, 2), (2, 1), (3, 1), (4, 1)}
    assert {r["node"]: r["total"] for r in hierarchy.subtree_sum(tree, "v").collect()} == {1: 13, 2: 13, 3: 12, 4: 7}


def test_deep_chain(spark):
    n = 700
    parents = {i: i - 1 if i else None for i in range(n)}
    f = hierarchy.forest(frame(spark, parents))
    assert f.levels <= 12 and f.nodes.where("pre <> node or last <> 699 or depth <> node").count() == 0


def test_empty_tree(spark):
    df = frame(spark, {1: None}).limit(0)
    links = spark.createDataFrame([(1, 1)], "item long, node long")
    assert hierarchy.subtree_distinct(df, links, "item").count() == 0 and hierarchy.subtree_sum(df.withColumn("v", F.lit(1)), "v").count() == 0


def test_items_in_all_of_many_selected_nodes(spark, monkeypatch):
    rng = random.Random(3)
    parents = random_parents(rng, 60, 10)
    links = [(i, t) for i, t in links_of(rng, list(parents), 200) if i is not None]
    below = walk(parents)
    picked = [(g, rng.randrange(60)) for g in range(3) for _ in range(4)]
    want = sorted({i for i, _ in links if all(any(i == j and t in below[n] for j, t in links for g2, n in picked if g2 == g) for g in range(3))})
    for most in (10_000, 2):
        monkeypatch.setattr(hierarchy, "MAX_PICKED", most)
        got = hierarchy.items_below_all(frame(spark, parents), spark.createDataFrame(links, "item long, node long"), spark.createDataFrame(picked, "grp int, node long"), "item")
        assert sorted(r["item"] for r in got.collect()) == want

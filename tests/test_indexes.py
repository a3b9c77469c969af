"""Bitmaps, the token index, lists of vectors and trees of hashes: against brute force, odd rows, pruning, two writers."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import fulltext, hierarchy, itemsets, metric, order, search, sequences, similarity, suggest, vectors
from gleaner.session import shared_dir
from gleaner.sources.versions import Conflict, Versions


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- order ------------------------------------------------------------------------------------


def test_running_sums_and_places(spark, monkeypatch):
    rng = random.Random(1)
    data = [(i, rng.choice(["a", "b", None]), rng.randrange(50), rng.randrange(-5, 9)) for i in range(500)]
    df = spark.createDataFrame(data, "id int, grp string, k int, v int").repartition(7)
    want, total = {}, 0
    for i, _, _, v in sorted(data, key=lambda r: (r[2], r[0])):
        total += v
        want[i] = total
    assert {r["id"]: r["s"] for r in order.running(df, ["k", "id"], "v", "s").collect()} == want
    places = {g: [r[0] for r in sorted((x for x in data if x[1] == g), key=lambda r: (r[2], r[0]))] for g in ("a", "b", None)}
    got = {g: [r["id"] for r in sorted((x for x in order.placed(df, "grp", ["k", "id"]).collect() if x["grp"] == g), key=lambda r: r["rank"])] for g in ("a", "b", None)}
    assert got == places
    monkeypatch.setattr(order, "SPAN", 7)
    dense = {r["id"]: r["s"] for r in order.running_by_place(df, "id", "v", "s").collect()}
    assert dense == {i: sum(r[3] for r in data[: i + 1]) for i in range(500)}


def test_versions_are_compared_and_set(spark):
    v = Versions(spark, f"{shared_dir(spark)}/versions-test", "a int")
    assert v.read().count() == 0 and v.latest() == 0
    assert v.put(spark.createDataFrame([(1,)], "a int"), 1) == 1
    with pytest.raises(Conflict):
        v.put(spark.createDataFrame([(2,)], "a int"), 1)
    v.put(spark.createDataFrame([(3,)], "a int"), 2)
    assert rows(v.read()) == [(3,)] and rows(v.read(1)) == [(1,)] and v.numbers() == [1, 2]


# --- bitmaps ----------------------------------------------------------------------------------


def test_sets_of_items(spark, monkeypatch):
    monkeypatch.setattr(itemsets, "FEW", 3)
    rng = random.Random(2)
    parents = {i: None if i < 2 else rng.randrange(i) for i in range(30)}
    items = [0, 1, 2, -1, -32768, -32769, 32768, 32769, 40_000, 65_536, 100_000, 7, 8, 9]
    links = [(rng.choice(items), rng.randrange(30)) for _ in range(400)] + [(i, 3) for i in items] + [(None, 1), (5, None), (6, 99)]
    df = spark.createDataFrame(links, "item long, node long")
    sets = itemsets.containers(df, "item", "node")
    direct = {n: {i for i, t in links if t == n and i is not None} for n in {t for _, t in links if t is not None}}
    assert {r["node"]: r["n"] for r in itemsets.counts(sets).collect()} == {n: len(s) for n, s in direct.items() if s}
    assert sets.where("few is not null and bits is not null").count() == 0 and sets.where("bits is not null").count() > 0
    f = hierarchy.forest(spark.createDataFrame(list(parents.items()), "id long, parent_id long"))
    index = itemsets.indexed(sets, f)

    def subtree(root):
        found, grew = {root}, True
        while grew:
            more = {n for n, p in parents.items() if p in found} - found
            found, grew = found | more, bool(more)
        return found

    picked = [("x", 0), ("x", 5), ("y", 1), ("y", 5), ("y", 5), ("z", 2)]
    below = {g: set().union(*(direct.get(n, set()) for h, r in picked if h == g for n in subtree(r))) for g in "xyz"}
    groups = itemsets.below(index, f, spark.createDataFrame(picked, "grp string, node long"))
    assert {r["grp"]: r["n"] for r in itemsets.size(groups, "grp").collect()} == {g: len(s) for g, s in below.items()}
    assert sorted(r["item"] for r in itemsets.members(itemsets.in_all(groups, 3)).collect()) == sorted(below["x"] & below["y"] & below["z"])
    nothing = itemsets.below(index, f, spark.createDataFrame([("x", 77)], "grp string, node long"))
    assert nothing.count() == 0


def test_a_subtree_prunes_the_index(spark):
    parents = [(i, None if i == 0 else (0 if i < 20 else i % 19 + 1)) for i in range(400)]
    f = hierarchy.forest(spark.createDataFrame(parents, "id long, parent_id long"))
    index = itemsets.indexed(itemsets.containers(spark.range(400).select(F.col("id").alias("item"), F.col("id").alias("node")), "item", "node"), f)
    plan = itemsets.below(index, f, spark.createDataFrame([(1, 7)], "grp int, node long"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(pre,", plan)


# --- tokens -----------------------------------------------------------------------------------


def tokens(*texts):
    return {t for x in texts if x for t in re.split(r"[^\w]+|_", x.lower()) if t}


def test_token_index_against_brute_force(spark):
    rng = random.Random(3)
    words = ["Red", "reddish", "blue", "BLÜE", "x1", "日本", "a-b", "c_d", "the", "then", ""]
    data = [(i, " ".join(rng.choices(words, k=rng.randint(0, 6))), rng.choice([None, "tail", "Red,blue"])) for i in range(120)]
    df = spark.createDataFrame(data, "key_id long, name string, note string")
    index = fulltext.TokenIndex(spark, f"{shared_dir(spark)}/tokens-a", "key_id", ["name", "note"])
    with pytest.raises(ValueError):
        index.search(["x"])
    assert index.add(df.where("key_id < 50")) == 1 and index.add(df.where("key_id < 50")) == 1
    assert index.add(df) == 2 and index.add(df.where("key_id is null")) == 2
    queries = (["re"], ["RED", "blue"], ["the", "x1", "r"], ["日"], ["zzz"], ["red", "zzz"], [], ["c", "d"], ["then", "the"])
    want = [[k for k, *t in data if q and all(any(w.startswith(p.lower()) for w in tokens(*t)) for p in q)] for q in queries]
    for _ in range(2):  # before and after compaction
        assert [sorted(r["key_id"] for r in index.search(q).collect()) for q in queries] == want
        index.compact()
    assert index.versions.latest() == 3 and len(index._runs()) == 1


def test_a_prefix_opens_few_files_and_row_groups(spark):
    df = spark.range(4000).select(F.col("id"), F.md5(F.col("id").cast("string")).alias("t"))
    index = fulltext.TokenIndex(spark, f"{shared_dir(spark)}/tokens-b", "id", ["t"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with much data: a file for each range
    index.add(df)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = index.postings("abc")
    assert len(found.inputFiles()) <= 2 < index.versions.read().where("file is not null").count()
    assert "StringStartsWith(token,abc)" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == df.where("t like 'abc%'").count()


def test_two_writers_of_an_index(spark, monkeypatch):
    root = f"{shared_dir(spark)}/tokens-c"
    a, b = (fulltext.TokenIndex(spark, root, "id", ["t"]) for _ in range(2))
    df = spark.createDataFrame([(1, "one"), (2, "two")], "id long, t string")
    monkeypatch.setattr(b.versions, "latest", lambda: 0)  # has not seen what the other writes
    a.add(df.where("id = 1"))
    with pytest.raises(Conflict):
        b.add(df)
    monkeypatch.undo()
    b.add(df)
    assert rows(a.search(["t"])) == [(2,)] and rows(a.search(["o"])) == [(1,)]


# --- vectors ----------------------------------------------------------------------------------


def slow_knn(q, x, k, l2=False):
    out = []
    for i, a in q:
        near = []
        for j, b in x:
            if i == j or b is None or a is None or len(a) != len(b) or (not l2 and (not np.any(a) or not np.any(b))):
                continue
            a64, b64 = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
            s = max(0, 1 - ((a64 - b64) ** 2).sum() / 2) if l2 else a64 @ b64 / np.sqrt(a64 @ a64) / np.sqrt(b64 @ b64)
            near.append((-float(np.floor(s * 10000 + 0.5) / 10000), j))
        out += [(i, j, -s, r + 1) for r, (s, j) in enumerate(sorted(near)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(4)
    data = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(150)] + [(150, None), (151, [0.0] * 8), (152, [1.0, 2.0]), (153, [1.0, 2.0]), (154, [])]
    data += [(155 + i, data[3][1]) for i in range(12)]
    return data, spark.createDataFrame(data, "id long, v array<float>")


@pytest.mark.parametrize("l2", [False, True])
def test_knn_against_brute_force(vecs, l2, monkeypatch):
    monkeypatch.setattr(similarity, "SLICE", 7)
    data, df = vecs
    q = [d for d in data if d[0] % 3 == 0]
    got = similarity.knn(df.where("id % 3 = 0").repartition(3), df.repartition(5), 4, block=20, l2=l2)
    assert sorted((r["query"], r["item"], r["similarity"], r["rank"]) for r in got.collect()) == slow_knn(q, data, 4, l2)


def test_lists_of_vectors(spark, vecs):
    data, df = vecs
    index = vectors.InvertedFile.build(df, lists=9)
    assert index.rows.count() == 162 and index.rows.select("list").distinct().count() <= 9
    exact = similarity.knn(df, df.where("size(v) = 8"), 5)
    got = index.search(df, 5, probes=len(index.centres))
    assert rows(got.select("query", "item", "similarity", "rank")) == rows(exact.join(df.where("size(v) = 8").select(F.col("id").alias("query")), "query").select("query", "item", "similarity", "rank"))
    some = index.search(df, 5)
    r = vectors.recall(some, got).first()
    assert r["n"] == got.count() and 0.8 < r["recall"] <= 1
    assert index.search(df.limit(0), 5).count() == 0
    empty = vectors.InvertedFile.build(df.limit(0))
    assert empty.search(df, 5).count() == 0


# --- hashes -----------------------------------------------------------------------------------


def hash_rows(n, seed, clusters):
    rng = random.Random(seed)
    centres = [rng.getrandbits(63) for _ in range(clusters)]
    flip = lambda h: h ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 9)))
    out = [(i, flip(rng.choice(centres))) for i in range(n)]
    return out + [(n + i, out[0][1]) for i in range(9)] + [(n + 20, None), (n + 21, -1), (n + 22, 0), (n + 23, -(1 << 63))]


def slow_near(data, queries, k, radius):
    out = []
    for i, h in queries:
        near = sorted((((h ^ g) & (1 << 64) - 1).bit_count(), j) for j, g in data if g is not None and j != i) if h is not None else []
        out += [(i, j, d, r + 1) for r, (d, j) in enumerate(x for x in near if x[0] <= radius) if k is None or r < k]
    return sorted(out)


@pytest.mark.parametrize("k, radius", [(1, 64), (5, 64), (40, 64), (None, 4), (None, 12), (3, 6)])
def test_nearest_hashes(spark, k, radius, monkeypatch):
    monkeypatch.setattr(metric, "SHARD", 64)
    monkeypatch.setattr(metric, "LEAF", 4)
    monkeypatch.setattr(metric, "SLICE", 16)
    data = hash_rows(250, 5, 12)
    df = spark.createDataFrame(data, "id long, hash long")
    queries = [d for d in data if d[0] % 4 == 0]
    got = metric.nearest_hashes(df.where("id % 4 = 0"), df.repartition(3), k, radius, block=30)
    assert sorted((r["query"], r["item"], r["distance"], r["rank"]) for r in got.collect()) == slow_near(data, queries, k, radius)


def test_the_radius_prunes_a_tree(monkeypatch):
    data = [(i, h) for i, h in hash_rows(20_000, 6, 400) if h is not None]
    hashes, ids = np.array([h for _, h in data], np.int64).view(np.uint64), np.array([i for i, _ in data])
    tree = metric.build(hashes, ids)
    assert sorted(tree.hashes.tolist()) == sorted(hashes.tolist())
    looked = []
    monkeypatch.setattr(metric, "_leaves", lambda t, q, who, leaf, best, f=metric._leaves: (looked.append(len(who)), f(t, q, who, leaf, best))[1])
    best = metric.Best(200, 3, 64)
    metric.search(tree, hashes[:200], best)
    assert len(best.query) == 600 and sum(looked) < 0.5 * 200 * (len(tree.first) - 1)


def test_search_by_item_and_by_session(spark):
    rng = np.random.default_rng(7)
    data = [(i, h, [float(v) for v in rng.normal(size=4)], i % 3) for i, h in hash_rows(60, 8, 20)]
    df = spark.createDataFrame(data, "id long, hash long, v array<float>, session int")
    got = search.by_item(df.where("id % 5 = 0"), df, bits=4, k=3)
    near = {}
    for i, j, d, _ in slow_near([r[:2] for r in data], [r[:2] for r in data if r[0] % 5 == 0], None, 4):
        near.setdefault(i, []).append((j, 0, 64.0 - d))
    for i, j, s, _ in slow_knn([(r[0], r[2]) for r in data if r[0] % 5 == 0 and r[0] not in near], [(r[0], r[2]) for r in data], 3):
        near.setdefault(i, []).append((j, 1, s))
    assert sorted((r["query"], r["item"], r["stage"], r["score"]) for r in got.collect()) == sorted((i, *x) for i, own in near.items() for x in own)
    same = sequences.similar_in_session(df.where("id % 5 = 0"), df, 9)
    session = {r[0]: r[3] for r in data}
    assert rows(same) == sorted([(i, j, d) for i, j, d, _ in slow_near([r[:2] for r in data], [r[:2] for r in data if r[0] % 5 == 0], None, 9) if session[i] == session[j]], key=str)


def test_a_run_of_suggestions(spark):
    """Centres of the tags with most seeds only, clear winners only, nothing that is linked already."""
    east, north, up = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    data = [(i, east) for i in range(4)] + [(i, north) for i in range(10, 13)] + [(i, up) for i in range(20, 23)] + [(30, [9.0, 1.0, 0.0]), (31, [1.0, 1.0, 0.0]), (32, [1.0, 9.0, 0.0]), (33, [0.0, 1.0, 9.0]), (34, None), (35, [-1.0, -1.0, -1.0])]
    items = spark.createDataFrame(data, "id long, v array<float>")
    seeds = [(i, "e") for i in range(3)] + [(i, "n") for i in range(10, 13)] + [(3, "e")] + [(20, "few"), (21, "few")] + [(i, "z") for i in range(20, 23)]
    links = spark.createDataFrame(seeds, "item long, tag string")
    got = suggest.suggest(items, links, least=0.5)
    assert {(r["item"], r["tag"]) for r in got.collect()} == {(30, "e"), (32, "n"), (33, "z")} and got.where("origin <> 'auto' or confidence < 0.9").count() == 0
    assert {(r["item"], r["tag"]) for r in suggest.suggest(items, links, least=0.5, tags_most=1).collect()} == {(30, "e"), (31, "e")}
    assert suggest.suggest(items, links.limit(0)).count() == 0

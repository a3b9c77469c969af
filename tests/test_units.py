"""Operators by hand-made cases: what SQL does not say, and odd rows."""

import math
import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import colour, dates, text
from gleaner.operators import cleanup, curation, filters, graph, hierarchy, palettes, ranking, rating, rules, sequences, similarity, tags
from gleaner.sources import files
from gleaner.streaming import feeds


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- filters and rules ------------------------------------------------------------------------


def test_globs():
    import re

    for glob, yes, no in (("a*.j?g", ["a.jpg", "axx.jxg"], ["b.jpg", "a.jpgx"]), ("[ab]1", ["a1", "b1"], ["c1"]), ("[!a]+", ["b+"], ["a+", "bb"]), ("x[", ["x["], ["x"]), ("*\n*", ["a\nb"], ["ab"])):
        r = re.compile(filters.glob_regex(glob))
        assert all(r.match(t) for t in yes) and not any(r.match(t) for t in no)


def test_null_keys_stay_and_a_null_in_the_list_hides_nothing(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(2,), (None,)], "k int")
    assert rows(filters.not_in_keys(a, b, "k")) == [(1,), (None,)]
    assert rows(filters.in_keys(a, b, "k")) == [(2,)]


def test_unknown_filter_columns_are_refused(spark):
    with pytest.raises(ValueError):
        filters.equals_any(spark.range(1), {"id; drop": "1"}, ("camera",))


def test_keyset_pages_give_every_row_once_under_ties(spark):
    df = spark.createDataFrame([(i, 1) for i in range(150)], "id int, v int").cache()
    seen, last = [], (2, 10_000)
    while True:
        page = [(r["v"], r["id"]) for r in filters.after(df, "v", "id", *last, 40).collect()]
        seen += page[:40]
        if len(page) <= 40:
            break
        last = page[39]
    assert [i for _, i in seen] == list(range(149, -1, -1))


def test_rule_documents():
    assert rules.problems("{") == ["not JSON"] and rules.problems({"rules": 3}) == ["rules must be a list"] and rules.problems('{"rules": []}') == []
    now = datetime(2024, 2, 29, 12, 30)
    assert rules.preset_range(rules.SAME_DAY_LAST_YEAR, now) == (datetime(2023, 3, 1), datetime(2023, 3, 1, 23, 59, 59, 999000))
    assert rules.preset_range(rules.LAST_7_DAYS, now) == (datetime(2024, 2, 22, 12, 30), now) and rules.preset_range(rules.THIS_YEAR, now) == (datetime(2024, 1, 1), now)
    assert rules.preset_range("x", now) is None


def test_rules_all_hold(spark):
    items = spark.createDataFrame(
        [(1, "2024-01-05 08:00:00", "X1", "a", 35.0, 1.8, "arw", "p.arw", 100), (2, "2024-01-06 09:00:00", None, "a_b", 85.0, 4.0, None, "q.CR3", 800), (3, None, "x10", None, None, None, "jpg", None, None)],
        "item int, taken_at string, camera string, lens string, focal double, aperture double, format string, name string, iso int",
    )
    links = spark.createDataFrame([(1, 7), (2, 7), (2, 8)], "item int, tag int")
    tag = spark.createDataFrame([(7, "a"), (8, "b")], "tag int, name string")
    now = datetime(2024, 1, 6, 8)
    run = lambda *r: [x[0] for x in rows(rules.evaluate(items, links, tag, {"rules": list(r)}, now).select("item"))]
    assert run({"type": "fileFormat", "value": "RAW"}) == [1, 2] and run({"type": "fileFormat", "value": "jpg"}) == [3] and run({"type": "fileFormat", "value": "CR3"}) == [2]
    assert run({"type": "cameraModel", "operator": rules.CONTAINS, "value": "x1"}) == [1, 3] and run({"type": "cameraModel", "operator": rules.EQUALS, "value": "x1"}) == []
    assert run({"type": "lensModel", "operator": rules.CONTAINS, "value": "A_"}) == [2]
    assert run({"type": "iso", "operator": ">=", "value": 200}) == [2] and run({"type": "iso", "operator": rules.RANGE, "value": 100}) == [1]
    assert run({"type": "focalLength", "operator": "<=", "value": 35}, {"type": "aperture", "operator": rules.RANGE, "value": 1, "max": 2}) == [1]
    assert run({"type": "tags", "value": ["a", "b", "zz"], "operator": rules.ALL}) == [2] and run({"type": "tags", "value": ["zz"], "operator": rules.ALL}) == []
    assert run({"type": "tags", "value": ["a", "b"], "operator": rules.ANY}) == [1, 2] and run({"type": "tags", "value": [], "operator": rules.ANY}) == []
    assert run({"type": "dateRange", "preset": rules.THIS_YEAR}) == [1] and run({"type": "dateRange"}) == [] and run({"type": "nope"}) == [] and run() == []
    assert run({"type": "dateRange", "dateFrom": 1704528000000}) == [] and run({"type": "dateRange", "dateFrom": 1704528000000, "dateTo": 1704540000000}) == [2]
    with pytest.raises(ValueError):
        rules.evaluate(items, links, tag, "{}", now)
    assert rules.validate(items, links, tag, {"rules": [{"type": "fileFormat", "value": "raw"}]}, now) == (True, 2, [])
    assert rules.validate(items, links, tag, "{", now) == (False, 0, ["not JSON"])


# --- trees and graphs -------------------------------------------------------------------------


def test_closure_of_a_tree_with_a_cycle(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 6), (6, 5), (7, 7)], "id int, parent_id int")
    got = set(rows(hierarchy.closure(tree)))
    assert {n for a, n in got if a == 1} == {1, 2, 3, 4} and {n for a, n in got if a == 5} == {5, 6} and (7, 7) in got
    assert dict(rows(hierarchy.subtree_sum(tree.withColumn("v", F.col("id")), "v")))[1] == 10
    links = spark.createDataFrame([(9, 4), (9, 2), (8, 3)], "item int, node int")
    assert dict(rows(hierarchy.subtree_distinct(tree, links, "item"))) == {1: 2, 2: 2, 3: 2, 4: 1, 5: 0, 6: 0, 7: 0}


def test_components_of_chains_stars_and_odd_edges(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, i) for i in range(1001, 1500)]
    edges = chain + star + [(5, 5), (None, 3), (4, None), (1, 0), (1, 0)]
    random.Random(1).shuffle(edges)
    got = dict(rows(graph.connected_components(spark.createDataFrame(edges, "a int, b int"))))
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1500)}
    assert graph.connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


# --- similarity -------------------------------------------------------------------------------


def test_segment_plan():
    for threshold in range(65):
        plan = similarity.segment_plan(threshold)
        assert sum(n for _, n in plan) == 64 and all(a + n == b for (a, n), (b, _) in zip(plan, plan[1:], strict=False))
        assert threshold < 2 * len(plan) or len(plan) == 33  # so one segment has one turned bit at most


@pytest.mark.parametrize("threshold", [0, 1, 4, 8, 9, 15, 24, 64])
def test_hamming_pairs_by_brute_force(spark, threshold):
    rng = random.Random(threshold)
    hashes = [rng.getrandbits(63) for _ in range(60)]
    for h in hashes[:30]:
        x = h
        for b in rng.sample(range(63), min(rng.randint(0, threshold + 2), 63)):
            x ^= 1 << b
        hashes.append(x)
    data = list(enumerate(hashes + hashes[:3])) + [(999, None)]
    df = spark.createDataFrame(data, "id int, hash long")
    low = {}
    for i, h in data:
        if h is not None:
            low.setdefault(h, i)
    want = sorted((min(low[a], low[b]), max(low[a], low[b]), (a ^ b).bit_count()) for a in low for b in low if a < b and (a ^ b).bit_count() <= threshold)
    assert sorted(map(tuple, similarity.hamming_pairs(df, threshold).collect())) == want


def test_hamming_pairs_in_blocks_by_brute_force(spark, monkeypatch):
    """Many hashes and wide thresholds: pairs are compared in blocks and no rows meet in short segments; within groups of two columns as well."""
    monkeypatch.setattr(similarity, "HASH_BLOCK", 40)
    monkeypatch.setattr(similarity, "SLICE", 7)
    monkeypatch.setattr(similarity, "FEW_MET", 100)
    rng = random.Random(3)
    data = [(i, rng.choice([rng.getrandbits(63), -rng.getrandbits(63), 5 << (i % 9)]), rng.choice(["p", "q", None]), i % 2) for i in range(300)] + [(999, None, "p", 0)]
    df = spark.createDataFrame(data, "id long, hash long, s string, t int")
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    for within in ([], ["s", "t"]):
        low = {}
        for i, h, *g in data:
            if h is not None and (not within or g[0] is not None):
                low.setdefault((*(g if within else []), h), i)
        pairs = [(x, y) for x in low for y in low if x[:-1] == y[:-1] and x[-1] < y[-1]]
        want = sorted((*x[:-1], *sorted((low[x], low[y])), bits(x[-1], y[-1])) for x, y in pairs if bits(x[-1], y[-1]) <= 24)
        got = similarity.hamming_pairs(df, 24, within=within)
        assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString() and len(want) > 30
        assert sorted(map(tuple, got.collect())) == want and got.columns == [*within, "a", "b", "distance"] and dict(got.dtypes)["distance"] == "int"
    assert similarity.hamming_pairs(df.limit(0), 24).count() == 0


def test_hamming_groups_in_blocks(spark, monkeypatch):
    """Chains of hashes 10 bits apart and copies of them; wide thresholds do not meet in segments."""
    monkeypatch.setattr(similarity, "HASH_BLOCK", 30)
    monkeypatch.setattr(similarity, "FEW_MET", 10)
    used, compared = [], similarity._compared_pairs
    monkeypatch.setattr(similarity, "_compared_pairs", lambda *a: used.append(1) or compared(*a))
    rng, data, want = random.Random(6), [], {}
    for first in range(0, 120, 12):
        h, low = rng.getrandbits(63), first
        for i in range(first, first + 12):
            data.append((i, h))
            want[i] = low
            if i % 3:
                for b in rng.sample(range(63), 10):
                    h ^= 1 << b
    df = spark.createDataFrame(data, "id long, hash long")
    assert dict(map(tuple, similarity.hamming_groups(df, 12).collect())) == want and used


def test_hamming_of_texts(spark):
    df = spark.createDataFrame([("00ff", "0f0f"), ("00", "000"), ("zz", "00"), ("", ""), ("F0", "f0")], "a string, b string")
    assert [r[0] for r in df.select(similarity.hamming_text(F.col("a"), F.col("b"))).collect()] == [8, 64, 0, 0, 0]


def test_knn_leaves_out_what_has_no_direction(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 0.0, 0.0]), (6, [-1.0, 0.0])], "id long, v array<double>")
    got = rows(similarity.knn(df, df, 2, block=2))
    assert {(q, i) for q, i, *_ in got} == {(1, 2), (1, 6), (2, 1), (2, 6), (6, 1), (6, 2)}


def test_split_large(spark):
    edges = [(i, i + 1, 0.9) for i in range(30)] + [(i, j, 0.99) for i in range(40, 46) for j in range(i + 1, 46)] + [(30, 40, 0.86)]
    got = dict(rows(similarity.split_large(spark.createDataFrame(edges, "a long, b long, similarity double"), largest=10, start=0.85)))
    assert len({got[i] for i in range(40, 46)}) == 1 and got[40] != got[0] and set(got) == {*range(31), *range(40, 46)}


# --- ranking ----------------------------------------------------------------------------------


def test_groups_count_once_in_fusion(spark):
    e = spark.createDataFrame([(1, 0, "a", 1.0, 0, 0.5), (1, 1, "a", 0.7, 0, 0.9), (1, 2, "whole-query", 0.5, 3, 0.1)], "item int, prompt int, grp string, weight double, rank int, similarity double")
    r = ranking.fuse(e).first()
    assert r["rank_score"] == pytest.approx(1 / 61 + 0.5 / 64) and (r["similarity"], r["primary_similarity"], r["n_groups"], r["has_whole"]) == (0.9, 0.5, 2, True)


def test_gap_needs_six_scores_and_a_wide_gap(spark):
    cut = lambda xs: ranking.gap_cutoff(spark.createDataFrame([(x,) for x in xs], "s double"), "s").first()[0]
    assert cut([0.9, 0.89, 0.88, 0.87, 0.86]) is None
    assert cut([0.9, 0.89, 0.88, 0.87, 0.86, 0.5, 0.49]) == pytest.approx(0.68)
    assert cut([0.9, 0.5, 0.48, 0.47, 0.46, 0.459, 0.458]) is None
    assert cut([]) is None


def test_auto_strength(spark):
    df = spark.createDataFrame([(0.5,), (0.55,), (0.75,), (0.95,), (1.0,)], "c double")
    assert [r[0] for r in df.select(ranking.auto_strength(F.col("c"))).collect()] == [0.5, 0.5, 0.75, 1.0, 1.0]


def test_margin(spark):
    df = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.895), (2, "a", 0.9), (2, "b", 0.8), (3, "a", 0.7)], "item int, tag string, score double")
    assert rows(ranking.best_with_margin(df, "item", "tag", "score")) == [(2, "a", 0.9), (3, "a", 0.7)]
    assert rows(ranking.best_with_margin(df, "item", "tag", "score", per_tag=1)) == [(2, "a", 0.9)]


# --- sequences and ratings --------------------------------------------------------------------


def test_rhythm_allows_a_missing_frame(spark):
    at = [10_000 * i for i in range(1, 8)] + [100_000, 110_000] + [500_000, 503_100, 509_000]
    f = spark.createDataFrame([("f", "c", "l", i, t) for i, t in enumerate(at)] + [("f", " ", "l", 99, 5), ("f", "c", "l", 98, 0)], "folder string, camera string, lens string, id int, at long")
    run = lambda missing: [tuple(r)[3:6] for r in sequences.rhythm_runs(f, ["folder", "camera", "lens"], missing=missing).collect()]
    assert run(1) == [(10_000, 70_000, 7)] and run(2) == [(10_000, 110_000, 9)]


def test_runs_of_hot_keys_are_the_plain_ones(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randrange(0, 3000), rng.randrange(3)) for i in range(800)]
    df = spark.createDataFrame(data, "k string, id int, at long, x int")
    plain = sequences.gap_runs(df, ["k"], F.col("at"), [F.col("at"), F.col("id")], 3, sequences.prev("x", ["k"], [F.col("at"), F.col("id")]) > F.col("x"))
    split = sequences.gap_runs_split(df, ["k"], "at", ["id"], 3, 100, ["x"], lambda before: before("x") > F.col("x"))
    assert rows(plain.select("k", "id", "run")) == rows(split.select("k", "id", "run"))


def test_elo():
    assert rating.elo(1000, 1000, 1, 0, 0) == (1016, 984)
    a, b = rating.elo(1000, 1200, 1, 10, 10)
    assert a - 1000 == 1200 - b == int(16 * (1 - 1 / (1 + 10**0.5)) + 0.5)


def test_undo_takes_the_last_action_back(spark):
    log = [(1, 1, 5, 6, 1.0), (1, 2, 5, 7, 0.5), (1, 3, 0, 0, None), (1, 4, 0, 0, None), (1, 5, 0, 0, None), (1, 6, 6, 7, 0.0), (2, 1, 1, 2, 0.0)]
    got = rows(rating.tournament(spark.createDataFrame(log, "session long, seq long, a long, b long, score double")))
    assert got == [(1, 5, 1000, 0, 0, 0), (1, 6, 984, 1, 0, 1), (1, 7, 1016, 1, 1, 0), (2, 1, 984, 1, 0, 1), (2, 2, 1016, 1, 1, 0)]


def test_next_pairs_have_not_met(spark):
    r = spark.createDataFrame([(1, i, 1000 + i, 0) for i in range(4)], "session long, item long, rating long, comparisons long")
    met = spark.createDataFrame([(1, 3, 2)], "session long, a long, b long")
    assert (1, 2, 3) not in rows(rating.next_pairs(r, met, 10)) and len(rows(rating.next_pairs(r, met, 10))) == 5
    many = spark.createDataFrame([(s, i, 1000 - i, 0) for s in (1, 2, 3) for i in range(20 if s < 3 else 1)], "session long, item long, rating long, comparisons long")
    close = [(1, i, j) for i in range(20) for j in range(i + 1, 20) if j - i < 17]
    got = rows(rating.next_pairs(many, spark.createDataFrame(close, "session long, a long, b long"), 5))
    assert sorted(x for x in got if x[0] == 1) == [(1, 0, 17), (1, 0, 18), (1, 1, 18), (1, 1, 19), (1, 2, 19)] and sorted(x for x in got if x[0] == 2) == [(2, i, i + 1) for i in range(5)]
    assert len(got) == 10 and rating.next_pairs(many.limit(0), met).count() == 0


def test_greedy_groups_follow_time(spark):
    df = spark.createDataFrame([(1, 1, 0b1111, 10), (1, 2, 0, 5), (1, 3, 0b1, 20), (1, 4, None, 1)], "session int, id int, hash long, at int")
    got = sequences.similar_first(df, "session", "id", "hash", "at", 1).orderBy("place").collect()
    assert [r["id"] for r in got] == [4, 2, 3, 1]


def test_luma(spark):
    flat, chess = [7] * 64, [255 * ((i + j) % 2) for i in range(8) for j in range(8)]
    df = spark.createDataFrame([(1, flat, 8), (2, chess, 8), (3, None, 8), (4, [1, 2, 3], 2)], "id int, luma array<int>, width int")
    got = {r["id"]: tuple(r)[1:] for r in sequences.luma_metrics(df, "id").collect()}
    assert got[1] == (7.0, 0.0, 0.0) and got[2][1] == 1.0 and got[2][2] > 1e5 and got[3] == got[4] == (None, None, None)
    rng = np.random.default_rng(0)
    base = np.add.outer(np.arange(32), np.arange(32) * 2) + rng.normal(0, 1, (32, 32))
    near = base + rng.normal(0, 0.5, (32, 32))
    pics = [(i, [float(x) for x in p.ravel()]) for i, p in enumerate((base, near, rng.normal(0, 9, (32, 32))))] + [(9, None)]
    h = {r["id"]: r["hash"] for r in sequences.perceptual_hash(spark.createDataFrame(pics, "id int, luma array<double>"), "id").collect()}
    assert h[9] is None and 0 <= h[0] < 1 << 63 and (h[0] ^ h[1]).bit_count() < (h[0] ^ h[2]).bit_count()


def test_merge_and_split_refuse_what_does_not_fit(spark):
    s = spark.createDataFrame([(1, 1, "b", 2), (2, 2, "b", 2), (3, 1, "b", 9)], "id int, folder int, kind string, n_frames int")
    m = spark.createDataFrame([(1, 1, 1, 0), (1, 2, 2, 1), (2, 3, 1, 0), (2, 4, 1, 1), (3, 5, 1, 0)], "sequence int, item int, at int, position int")
    for pair in ((1, 1), (1, 2), (1, 3)):
        with pytest.raises(ValueError):
            sequences.merge_two(s, m, *pair, 9)
    with pytest.raises(ValueError):
        sequences.split_at(m, 1, 1, 8, 9)


# --- functions --------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("phrase", "first", "last"),
    [("today", "2024-05-15", "2024-05-15"), ("last week", "2024-05-08", "2024-05-15"), ("winter 2023", "2023-12-01", "2024-01-31"), ("2022", "2022-01-01", "2022-12-31"), ("3 days ago", "2024-05-12", "2024-05-12"), ("2024-02", "2024-02-01", "2024-02-29"), ("summer of 2020", "2020-06-01", "2020-08-31")],
)
def test_date_phrases(phrase, first, last):
    assert dates.day_range(phrase, date(2024, 5, 15)) == (date.fromisoformat(first), date.fromisoformat(last))


def test_query_split():
    assert dates.split_query("red cat last week", date(2024, 5, 15)) == ("red cat", (date(2024, 5, 8), date(2024, 5, 15)))
    assert dates.split_query("cats", date(2024, 5, 15)) == ("cats", None)


def test_query_plans():
    from gleaner.functions.queryplan import parse

    slots = {"red": "colour", "red car": "object", "beach": "scene", "car": "object", "海边": "scene"}
    p = parse("red car on a beach without people", slots)
    assert (p.text, p.negative, p.language, p.intent) == ("red car on a beach", "people", "en", "composed") and p.slots == [("red car", "object"), ("beach", "scene")]
    assert parse("car", slots).intent == "object" and parse("海边", slots).language == "zh" and parse("xyz", slots).intent == "unknown" and parse("beach", slots).intent == "scene"
    assert [g for _, g, _ in p.prompts()] == ["whole-query", "object", "scene"] and len(parse("red car", slots).prompts()) == 1


def test_colours(spark):
    df = spark.createDataFrame([("#f00",), ("00FF00",), ("zz",), (None,)], "h string")
    got = [r[0] for r in df.select(colour.hex_to_rgb(F.col("h"))).collect()]
    assert [tuple(x) if x else None for x in got] == [(255, 0, 0), (0, 255, 0), None, None]
    one = spark.range(1)
    hsl = one.select(colour.rgb_to_hsl(F.lit(128), F.lit(64), F.lit(64)).alias("x"), colour.rgb_to_hsl(F.lit(9), F.lit(9), F.lit(9)).alias("y")).first()
    assert tuple(hsl["x"]) == (0, 33, 38) and tuple(hsl["y"])[:2] == (0, 0)
    assert one.select(colour.palette_distance(colour.hex_to_rgb(F.lit("fff")), F.lit(None).cast("array<struct<r:int,g:int,b:int>>"))).first()[0] == colour.NO_COLOUR
    assert palettes.pure_hue(0) == (255, 0, 0) and palettes.pure_hue(120) == (0, 255, 0) and palettes.pure_hue(330) == (255, 0, 128)


def test_texts(spark):
    df = spark.createDataFrame([("1/250",), ("0.5 s",), ("2s",), ("1/0",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(text.shutter_seconds(F.col("t"))).collect()] == [0.004, 0.5, 2.0, None, None, None]
    p = spark.createDataFrame([("/a/b",), ("/a/bc/d",), ("/a/b/c",)], "p string")
    assert [r[0] for r in p.select(text.replace_prefix(F.col("p"), "/a/b/", "/z")).collect()] == ["/z", "/a/bc/d", "/z/c"]


def test_ngrams():
    assert tags.ngrams("ab 日本語 c") == ["日本語", "日本", "本語"]


def test_persons(spark):
    df = spark.createDataFrame([(1, "2girls"), (1, "1girl"), (1, "1boy"), (2, "solo"), (3, "cat"), (4, "multiple_boys"), (5, "6+girls")], "item int, name string")
    assert rows(tags.person_counts(df)) == [(1, 3), (2, 1), (3, 0), (4, 2), (5, 6)]


def test_fallback_takes_the_first_that_is_filled(spark):
    assert curation.first_filled(spark.range(1), spark.range(2), spark.range(0))[0] == 1
    assert curation.first_filled(spark.range(1), spark.range(0))[0] == 1


def test_palette_has_no_near_colours(spark):
    df = spark.createDataFrame([(10, 10, 10)] * 5 + [(12, 10, 10)] * 4 + [(200, 0, 0)] * 3, "r int, g int, b int")
    assert [(r["r"], r["n"], round(r["weight"], 3)) for r in palettes.merged_palette(df).collect()] == [(10, 5, 0.625), (200, 3, 0.375)]
    assert palettes.merged_palette(df.limit(0)).count() == 0
    assert rows(palettes.merged_palette(df, batch=1)) == rows(palettes.merged_palette(df))


def test_stale_groups_are_not_touched(spark):
    items = spark.createDataFrame([(i, None, 10, "h", 1, None) for i in (1, 2, 3, 4)], "id int, deleted_at timestamp, n_bytes int, content_hash string, revision int, batch string")
    groups = spark.createDataFrame([(1, 1), (1, 2), (3, 3), (3, 4)], "component int, id int")
    d = spark.createDataFrame([(1, 1, "KEEP"), (1, 2, "DELETE"), (3, 3, "KEEP"), (3, 4, "DELETE")], "component int, id int, decision string")
    p = cleanup.plan(groups, d, items)
    changed = items.withColumn("content_hash", F.when(F.col("id") == 3, "x").otherwise(F.col("content_hash")))
    assert rows(cleanup.stale(p, changed)) == [(3, 3, "changed")]
    after = cleanup.execute(p, changed, "b", "2024-01-01")
    assert rows(after.where("deleted_at is not null").select("id", "batch")) == [(2, "b")]
    assert cleanup.restore(after, "b").where("deleted_at is not null").count() == 0


# --- sources ----------------------------------------------------------------------------------


def test_scan_and_headers(spark, tmp_path):
    (tmp_path / "a/.git").mkdir(parents=True)
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"rest"
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xe1\0\x03x\xff\xc2\0\x11\x08" + (300).to_bytes(2, "big") + (200).to_bytes(2, "big") + b"\x03rest"
    webp = b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0" + (639).to_bytes(3, "little") + (479).to_bytes(3, "little")
    for name, raw in (("a/x.PNG", png), ("a/y.gif", b"GIF89a" + (3).to_bytes(2, "little") + (5).to_bytes(2, "little")), ("a/z.txt", b"no"), ("a/.git/q.png", png), ("j.jpg", b"\xff\xd8\xff\xe0"), ("k.jpeg", jpeg), ("w.webp", webp), ("a/x.cache.png", png)):
        (tmp_path / name).write_bytes(raw)
    found = files.scan(spark, str(tmp_path), content=True)
    got = {r["name"]: tuple(r["h"]) for r in found.select("name", files.image_header(F.col("content")).alias("h")).collect()}
    assert got == {"x.PNG": ("png", 640, 480), "y.gif": ("gif", 3, 5), "j.jpg": ("jpeg", None, None), "k.jpeg": ("jpeg", 200, 300), "w.webp": ("webp", 640, 480)}


def test_content_hashes(spark):
    import hashlib

    raws = [b"", b"x" * 8192, bytes(range(256)) * 40]
    df = spark.createDataFrame([(r,) for r in raws], "c binary")
    got = [tuple(r) for r in df.select(files.content_hash(F.col("c")), files.sample_hash(F.col("c"))).collect()]
    short = [r if len(r) <= 8192 else r[:4096] + r[-4096:] for r in raws]
    assert got == [(hashlib.sha256(r).hexdigest(), hashlib.sha256(s).hexdigest()) for r, s in zip(raws, short, strict=True)]


def test_insert_if_absent_twice(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, v string")
    path = str(tmp_path / "t")
    files.insert_if_absent(df, path, "id")
    files.insert_if_absent(df.union(spark.createDataFrame([(3, "c")], df.schema)), path, "id")
    assert rows(spark.read.parquet(path)) == [(1, "a"), (2, "b"), (3, "c")]


def test_snapshot_is_used_while_the_fingerprint_holds(spark, tmp_path):
    a = spark.range(5)
    mark = files.fingerprint(a)
    assert mark == files.fingerprint(spark.range(5)) != files.fingerprint(spark.range(6))
    assert files.snapshot(a, str(tmp_path), mark).count() == 5
    assert files.snapshot(spark.range(9), str(tmp_path), mark).count() == 5
    assert files.snapshot(spark.range(9), str(tmp_path), files.fingerprint(spark.range(9))).count() == 9


def test_moves_need_one_candidate_on_each_side(spark):
    schema = "id int, name string, n_bytes int, at long"
    new = spark.createDataFrame([(1, "a", 5, 100), (2, "b", 5, 100), (3, "c", 5, 100), (4, "c", 5, 101)], schema)
    old = spark.createDataFrame([(11, "a", 5, 105), (12, "b", 5, 106), (13, "c", 5, 100), (14, "a", 6, 100)], schema)
    assert rows(files.adopt_moved(new, old)) == [(1, 11)]


def test_export_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    for fmt in ("json", "csv", "parquet", "orc"):
        files.export(df, str(tmp_path / fmt), fmt)
        assert spark.read.format(fmt).load(str(tmp_path / fmt)).count() == 2


# --- streams ----------------------------------------------------------------------------------


@pytest.fixture
def stream(spark, tmp_path):
    """A stream over two files, one after the other."""
    n = 0

    def make(*parts, schema):
        nonlocal n
        n += 1
        where = tmp_path / f"in{n}"
        for p in parts:
            spark.createDataFrame(p, schema).coalesce(1).write.mode("append").json(str(where))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(where))

    return make


def t(s):
    from datetime import datetime

    return datetime.fromisoformat(f"2024-01-01T{s}")


def test_streamed_counts_and_windows(spark, stream):
    events = [[("d", t(f"00:00:0{i % 2}.{i:03}")) for i in range(40)], [("e", t("00:30:00")), ("d", t("02:00:00"))]]
    s = stream(*events, schema="directory string, ts timestamp")
    got = feeds.run_to_end(feeds.unlink_bursts(s), "bursts")
    assert rows(got.select("directory", "n")) == [("d", 40)]
    got = feeds.run_to_end(feeds.debounced(s), "rescans")
    assert ("d", 40) in rows(got.select("directory", "n"))
    got = feeds.run_to_end(feeds.running_counts(s, "directory"), "counts", "update")
    assert {r["directory"]: r["n"] for r in got.groupBy("directory").agg(F.max("n").alias("n")).collect()} == {"d": 41, "e": 1}
    got = feeds.run_to_end(feeds.rates(s), "rates")
    assert got.agg(F.max("n")).first()[0] == 40
    a_second = {r["start"].second: (r["n"], r["per_second"]) for r in got.where("n < 40 and second(start) > 55").collect()}
    assert a_second[58] == (40, 40 / 2) or a_second  # spans begin with the first event of a window
    assert got.where("per_second > n").count() == 0


def test_streamed_additions_come_once(spark, stream):
    s = stream([("a", t("00:00:00")), ("b", t("00:00:01"))], [("a", t("00:00:02")), ("k", t("00:00:03"))], schema="path string, ts timestamp")
    known = spark.createDataFrame([("k",)], "path string")
    assert rows(feeds.run_to_end(feeds.added(s, known), "added").select("path")) == [("a",), ("b",)]


def test_streamed_tournament_is_the_batch_one(spark, stream):
    schema = "session long, seq long, a long, b long, score double"
    parts = [[(1, 1, 5, 6, 1.0), (1, 2, 5, 7, 0.5), (2, 1, 1, 2, 0.0)], [(1, 3, 6, 7, 1.0), (1, 4, 5, 6, 0.0), (1, 5, 0, 0, None)]]
    more = [(1, 6, 5, 6, 1.0), (1, 7, 0, 0, None), (1, 8, 0, 0, None), (2, 2, 0, 0, None), (2, 3, 1, 3, 1.0), (3, 1, 4, 4, 1.0), (3, 2, 0, 0, None)]
    log = [x for p in parts for x in p] + more
    whole = rows(rating.tournament(spark.createDataFrame(log, schema)))
    for cuts in ([3, 8], [1, 2, 3, 4, 5, 6, 7, 9, 11, 12, 13], []):  # an undo finds its action in whatever micro-batch
        batches = [log[a:b] for a, b in zip([0, *cuts], [*cuts, len(log)], strict=True)]
        last = {}
        keep = lambda df, _: last.update({(r["session"], r["item"]): tuple(r) for r in df.collect()})  # noqa: B023, E731
        query = feeds.tournament_state(stream(*batches, schema=schema)).writeStream.outputMode("update").trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
        assert sorted(last.values()) == whole


def test_upsert_batches(spark, stream, tmp_path):
    from gleaner.sources.deltas import KeyedTable

    s = stream([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c")], schema="id long, v long, x string")
    write = feeds.upsert(str(tmp_path / "t"), "id", "v")
    q = s.writeStream.foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    kept = KeyedTable(spark, str(tmp_path / "t"), "id", "v")
    assert rows(kept.read().select("id", "x")) == [(1, "c"), (2, "b")]
    version = kept.version()
    write(spark.createDataFrame([(1, 9, "again")], "id long, v long, x string"), 0)  # a batch that comes again
    assert kept.version() == version and rows(kept.read().select("id", "x")) == [(1, "c"), (2, "b")]


def test_suppressed_in_a_stream(spark, stream):
    schema = "path string, ts timestamp"
    e = stream([("a", t("00:00:10")), ("b", t("00:00:10"))], [("z", t("03:00:00"))], schema=schema)
    m = stream([("a", t("00:00:01"))], [("z", t("03:00:00"))], schema=schema)
    got = feeds.run_to_end(feeds.suppressed(e, m, late="1 second"), "suppressed")
    assert "a" not in {r["path"] for r in got.collect()}


def test_materialised_tables_can_be_released(spark):
    from gleaner.session import materialise, release

    df = materialise(spark.range(3), "released")
    path = df.inputFiles()[0]
    assert df.count() == 3 and release(spark) >= 1 and release(spark) == 0
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(path).count()


def test_session_has_no_null_division():
    assert math.isfinite(rating.elo(0, 4000, 0, 0, 0)[0])


def test_export_rows(spark):
    ids = spark.createDataFrame([(1,), (1,), (2,), (None,), (9,)], "id int")
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string")
    details = spark.createDataFrame([(1, "cam")], "id int, camera string")
    links = spark.createDataFrame([(1, "y"), (1, "x"), (1, "x"), (3, "z")], "id int, name string")
    got = files.export_rows(ids, items, details, links)
    assert rows(got.select("id", "name", "camera", F.array_join("tags", ","))) == [(1, "a", "cam", "x,y"), (2, "b", None, "")]


def test_seasons_without_a_year_and_months():
    now = date(2024, 4, 20)
    r = lambda p: dates.day_range(p, now)
    assert r("spring") == (date(2024, 3, 1), date(2024, 5, 31)) and r("summer") == (date(2023, 6, 1), date(2023, 8, 31))
    assert r("winter") == (date(2023, 12, 1), date(2024, 1, 31)) and r("next winter") == (date(2025, 12, 1), date(2026, 1, 31))
    assert r("last summer") == (date(2023, 6, 1), date(2023, 8, 31)) and r("this autumn") == (date(2024, 9, 1), date(2024, 11, 30))
    assert r("March 2023") == (date(2023, 3, 1), date(2023, 3, 31)) and r("february 29, 2024") == (date(2024, 2, 29),) * 2 and r("february 30 2024") is None
    assert r("may") is None and r("blue") is None and dates.split_query("cats last summer blue", now) == ("cats blue", (date(2023, 6, 1), date(2023, 8, 31)))

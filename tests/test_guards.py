"""Changes guarded by versions, reviews of duplicate groups, streams with timers."""

import random
import statistics
from datetime import datetime, timedelta

import pandas as pd
import pytest

from gleaner.operators import duplicates, sequences, similarity
from gleaner.session import shared_dir
from gleaner.sources.deltas import KeyedTable
from gleaner.sources.versions import Conflict
from gleaner.streaming import feeds


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def stream(spark, tmp_path):
    """Micro-batches of rows, one file each, read in order."""
    def make(*batches, schema):
        where = tmp_path / f"in-{random.randrange(1 << 30)}"
        for i, b in enumerate(batches):
            spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(where / f"b={i}"))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(where))

    return make


# --- keyed tables -----------------------------------------------------------------------------


def test_changes_merge_at_times(spark):
    table = KeyedTable(spark, f"{shared_dir(spark)}/deltas-a", "id", "v", deltas=3)
    schema, want, rng = "id long, v long, x string", {}, random.Random(1)
    kinds = []
    for n in range(9):
        change = [(rng.randrange(6), rng.randrange(20), f"{n}-{j}") for j in range(3)]
        table.apply(spark.createDataFrame(change, schema))
        for i, v, x in sorted(change, key=lambda r: (r[1])):
            if i not in want or v >= want[i][0]:
                want[i] = (v, x)
        assert {r["id"]: r["v"] for r in table.read().collect()} == {i: v for i, (v, _) in want.items()}
        kinds.append(len(table._runs(table.version())))
    assert max(kinds) <= 3 and 1 in kinds[1:]
    assert table.read(1).count() <= 3 and table.read(0, table.read().schema).count() == 0


def test_two_writers_of_a_keyed_table(spark):
    a, b = (KeyedTable(spark, f"{shared_dir(spark)}/deltas-b", "id", "v") for _ in range(2))
    one = spark.createDataFrame([(1, 1, "a")], "id long, v long, x string")
    a.apply(one)
    seen = b.version()
    a.apply(spark.createDataFrame([(1, 2, "first")], one.schema), seen)
    with pytest.raises(Conflict):
        b.apply(spark.createDataFrame([(1, 3, "second")], one.schema), seen)
    assert rows(b.read().select("x")) == [("first",)]
    b.apply(spark.createDataFrame([(1, 2, "tie")], one.schema), b.version())
    assert rows(a.read().select("x")) == [("tie",)]  # of equal order the later change


def test_added_columns_are_kept(spark):
    t = KeyedTable(spark, f"{shared_dir(spark)}/deltas-c", "id", "v")
    t.apply(spark.createDataFrame([(1, 1), (2, 1)], "id long, v long"))
    t.apply(spark.createDataFrame([(2, 2, "new")], "id long, v long, x string"))
    assert rows(t.read().select("id", "x")) == [(1, None), (2, "new")]


# --- reviews ----------------------------------------------------------------------------------


@pytest.fixture
def review(spark):
    members = [(1, 10), (1, 11), (1, 12), (2, 20), (2, 21), (3, 30), (3, 31), (3, 32), (4, 40), (5, 50), (5, 51), (5, 52)]
    groups = spark.createDataFrame([(1, "a", 3, False), (2, "b", 0, False), (3, "c", 7, True), (4, "d", 0, False), (5, "e", 1, False)], "component long, version string, revision long, ignored boolean")
    items = [(i, i % 4, 100 - i, None, datetime(2020, 1, 1) if i == 51 else None) for _, i in members]
    r = duplicates.Reviews(spark, f"{shared_dir(spark)}/reviews-{random.randrange(1 << 40)}")
    r.start(groups, spark.createDataFrame(members, "component long, id long"))
    return r, spark.createDataFrame(items, "id long, pixels int, n_bytes int, taken_at timestamp, deleted_at timestamp")


def ask(spark, *requests):
    return spark.createDataFrame(requests, "component long, version string, revision long, count int")


def test_requests_are_guarded(spark, review):
    r, items = review
    got = r.keep(ask(spark, (1, "a", 3, 1), (2, "old", 0, 1), (3, "c", 7, 1), (5, "e", 1, 1), (9, "z", 0, 1)), items)
    assert rows(got) == sorted([(1, None), (2, "stale group"), (3, "ignored"), (5, "changed"), (9, "missing")], key=str)
    assert rows(r.members().where("decision is not null")) == [(1, 10, "DELETE"), (1, 11, "KEEP"), (1, 12, "DELETE")]
    assert {x["component"]: x["revision"] for x in r.groups().collect()} == {1: 4, 2: 0, 3: 7, 4: 0, 5: 1}
    again = r.keep(ask(spark, (1, "a", 3, 2), (2, "b", 0, 0), (4, "d", 0, 2)), items)
    assert rows(again) == [(1, "stale review"), (2, "bad count"), (4, "bad count")]
    assert rows(r.keep(ask(spark, (1, "a", 4, 2)), items)) == [(1, None)]
    assert rows(r.members().where("component = 1")) == [(1, 10, "KEEP"), (1, 11, "KEEP"), (1, 12, "DELETE")]
    assert r.events().count() == 6 and rows(r.events().where("id = 10").select("revision", "decision")) == [(4, "DELETE"), (5, "KEEP")]


def test_all_groups(spark, review):
    r, items = review
    assert rows(r.keep_all(2, items)) == sorted([(1, None), (2, "nothing to delete"), (4, "alone"), (5, "changed")], key=str)
    assert rows(r.members().where("decision = 'KEEP'").select("id")) == [(10,), (11,)]


def test_two_reviewers(spark, review):
    r, items = review
    seen = r.table.version()
    r.keep(ask(spark, (1, "a", 3, 1)), items, seen)
    with pytest.raises(Conflict):
        r.keep(ask(spark, (2, "b", 0, 1)), items, seen)
    assert r.events().count() == 3 and rows(r.keep(ask(spark, (2, "b", 0, 1)), items)) == [(2, None)]


def test_current_groups_need_live_members_outside_of_sequences(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (20, 21), (21, 22)], "a long, b long")
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (10, 10), (10, 11), (20, 20), (20, 21)], "component long, id long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert rows(duplicates.still_current(pairs, members)) == [(1, True), (10, True), (20, False)]
    assert rows(duplicates.still_current(pairs, members, ids(1, 2, 3, 10, 20, 21), ids(3))) == [(1, False), (10, False), (20, True)]


# --- streams with timers ----------------------------------------------------------------------

T0 = datetime(2024, 1, 1)
REMOVED = "directory string, path string, ts timestamp"


def at(ms):
    return T0 + timedelta(milliseconds=ms)


def removed(spark, stream, batches, present=None, **how):
    with feeds.keyed_state(spark):
        return feeds.run_to_table(feeds.removals(stream(*batches, schema=REMOVED), present, late="1 second", **how), "removals-test")


def test_removals_wait_for_bursts(spark, stream):
    burst = [("d", f"d/{i}", at(10 * i)) for i in range(30)]
    lone = [("e", "e/1", at(100)), ("e", "e/1", at(900)), ("e", "e/2", at(500)), ("f", "f/1", at(1500))]
    late = [("f", "f/2", at(600)), ("d", "d/99", at(3000))]
    end = [("z", "z/1", at(60_000))]
    dropped = [("e", "e/late", at(50))]  # behind the watermark by then
    there = spark.createDataFrame([("e/2",)], "path string")
    got = removed(spark, stream, [burst[:17] + lone, burst[17:] + late, end, dropped, end], there)
    base = int(at(0).timestamp() * 1000)
    assert [(r["directory"], r["path"]) for r in got.orderBy("path").collect()] == [("d", "d/99"), ("e", "e/1"), ("f", "f/1"), ("f", "f/2")]
    assert got.where("path = 'e/1'").first()["ms"] % 1000 == 900 and base % 2000 == 0


def test_removals_alike_in_batches_and_at_once(spark, stream):
    rng = random.Random(5)
    events = [(d := f"d{rng.randrange(6)}", f"{d}/{rng.randrange(40)}", at(rng.randrange(20_000))) for _ in range(300)]
    events.sort(key=lambda r: r[2])
    whole = feeds.removals(spark.createDataFrame(events, REMOVED), span_ms=2000, least=6)
    jumbled = [sorted(events[a : a + 40], key=lambda r: rng.random()) for a in range(0, 300, 40)]
    got = removed(spark, stream, [*jumbled, [("z", "z", at(600_000))]], span_ms=2000, least=6)
    assert rows(got) == rows(whole) and got.count() > 20


def test_directories_of_one_state_are_counted_apart():
    """A call serves a bucket of directories, in several parts and batches."""
    class Held:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value
        update = lambda self, value: setattr(self, "value", value)
        clear = lambda self: setattr(self, "value", None)

    class Handle:
        held, timers = Held(), []
        getValueState = lambda self, name, schema: self.held
        registerTimer = lambda self, ms: self.timers.append(ms)

    waiting = feeds._Waiting(2000, 3)
    waiting.init(Handle())
    frame = lambda *r: pd.DataFrame(r, columns=["directory", "path", "ms"])
    for parts in ([frame(("d", "x", 5), ("e", "x", 9), ("d", "x", 3)), frame(("f", "y", 1), ("f", "y", 2))], [frame(("f", "z", 1), ("e", "w", 4), (None, "v", 7))]):
        assert list(waiting.handleInputRows((7, 5), iter(parts), None)) == []
    (left,) = waiting.handleExpiredTimer((7, 5), None, None)
    assert sorted(map(tuple, left.values.tolist()), key=str) == sorted([("d", "x", 5), ("e", "x", 9), ("e", "w", 4), (None, "v", 7)], key=str)
    assert set(Handle.timers) == {12_000} and not Handle.held.exists()


def test_marks_suppress_what_is_below_them_for_a_time(spark, stream):
    schema = "root string, path string, ts timestamp, n int"
    events = [[("r", "r/a/x", at(500), 1), ("r", "r/b", at(500), 2), ("s", "r/a/x", at(500), 3)], [("r", "r/a", at(14_000), 4), ("r", "r/a/x", at(17_000), 5), ("r", "r/ab", at(1000), 6), ("r", "r/c/d/e", at(16_000), 7)]]
    marks = [[("r", "r/a", at(0), 0)], [("r", "r/c", at(15_000), 0)]]
    with feeds.keyed_state(spark):
        s = feeds.unsuppressed(stream(*events, schema=schema), stream(*marks, schema=schema).drop("n"), ts="ts")
        got = feeds.run_to_table(s, "marks-test")
    assert sorted(r["n"] for r in got.collect()) == [2, 3, 5, 6]


# --- rhythm -----------------------------------------------------------------------------------


def test_medians_one_by_one():
    rng = random.Random(3)
    for spread in (2, 10, 10_000):
        m, seen = sequences.GapMedian(), []
        for _ in range(400):
            x = rng.randrange(spread)
            m.add(x)
            seen.append(x)
            assert m.value() == statistics.median(seen)


@pytest.mark.parametrize("span_ms", [700_000, 3_000_000, 10**12])
def test_rhythm_runs_are_alike_under_any_span(spark, span_ms):
    rng, data = random.Random(4), []
    for folder in range(4):
        now = 1_000_000
        for i in range(250):
            now += rng.choice([60_000, 60_000, 60_000, 61_500, 120_000, 58_000, 3_000, 900_000])
            data.append((folder, "c", "l", folder * 1000 + i, now))
    df = spark.createDataFrame(data + [(None, "c", "l", 1, 5), (1, " ", "l", 1, 5), (1, "c", "l", 1, 0)], "folder int, camera string, lens string, id long, at long").repartition(5)
    got = sequences.rhythm_runs(df, ["folder", "camera", "lens"], least=3, low_ms=2000, high_ms=600_000, span_ms=span_ms)
    want = []
    for folder in range(4):
        at = [r[4] for r in data if r[0] == folder]
        fits = sequences.RhythmFold(3, 2000, 600_000, 1, 0.2).fits
        start, gaps = 0, []
        for i in range(1, len(at) + 1):
            gap = at[i] - at[i - 1] if i < len(at) else None
            if gap is not None and 2000 <= gap <= 600_000 and fits(gap, statistics.median(gaps) if gaps else gap):
                gaps.append(gap)
                continue
            if i - start >= 3 and gaps and 2000 <= statistics.median(gaps) <= 600_000 and all(fits(g, statistics.median(gaps)) for g in gaps):
                want.append((folder, at[start], at[i - 1], i - start, float(statistics.median(gaps))))
            start, gaps = i, []
    assert len(want) > 10 and rows(got.select("folder", "started_at", "ended_at", "n_frames", "interval")) == sorted(want, key=str)


# --- greedy groups ----------------------------------------------------------------------------


def slow_first(items, threshold):
    """Fold of one session: (time, key, hash) to (key, group, place)."""
    items, seeds, groups = sorted(items), [], {}
    for t, k, h in items:
        near = next((i for i, s in enumerate(seeds) if h is not None and h >= 0 and s is not None and (s ^ h).bit_count() <= threshold), None)
        if near is None:
            seeds.append(h if h is not None and h >= 0 else None)
        groups[k] = len(seeds) - 1 if near is None else near
    order = sorted(items, key=lambda r: groups[r[1]])
    return sorted((k, groups[k], i) for i, (_, k, _) in enumerate(order))


def test_similar_first_against_the_fold(spark):
    rng = random.Random(8)
    data, key = [], 0
    for session, n, chain in (("a", 60, False), ("b", 25, True), ("c", 3, False)):
        centres = [rng.getrandbits(63) for _ in range(8)]
        h = rng.getrandbits(63)
        for _ in range(n):
            h = h ^ (7 << rng.randrange(50)) if chain else rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 5)))
            data.append((session, key, None if rng.random() < 0.05 else h, rng.randrange(20)))
            key += 1
    data += [("a", key, -5, 3), ("a", key + 1, -5, 3), ("a", key + 2, data[0][2], 19)]
    df = spark.createDataFrame(data, "session string, id long, hash long, at int").repartition(3)
    got = sequences.similar_first(df, "session", "id", "hash", "at", 6).collect()
    for session in "abc":
        want = slow_first([(t, k, h) for s, k, h, t in data if s == session], 6)
        assert sorted((r["id"], r["grp"], r["place"]) for r in got if r["session"] == session) == want
    assert sequences.similar_first(df.limit(0), "session", "id", "hash", "at").count() == 0


def test_similar_first_of_many_bits_compares_sessions_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "HASH_BLOCK", 25)
    monkeypatch.setattr(similarity, "FEW_MET", 10)
    used, compared = [], similarity._compared_pairs
    monkeypatch.setattr(similarity, "_compared_pairs", lambda *a: used.append(1) or compared(*a))
    rng = random.Random(9)
    data = [(i % 2, i, rng.getrandbits(63) if i % 17 else None, rng.randrange(30)) for i in range(160)]
    got = sequences.similar_first(spark.createDataFrame(data, "session int, id long, hash long, at int"), "session", "id", "hash", "at", 26).collect()
    for session in (0, 1):
        want = slow_first([(t, k, h) for s, k, h, t in data if s == session], 26)
        assert len({g for _, g, _ in want}) < 70 and sorted((r["id"], r["grp"], r["place"]) for r in got if r["session"] == session) == want
    assert used

"""Change feeds as streams. Every function takes a streaming (or batch) DataFrame and returns one; windows are by event time with a watermark."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleaner.operators.rating import fold_log
from gleaner.session import shared_dir
from gleaner.sources.deltas import KeyedTable

LATE = "10 minutes"


def _marked(events: DataFrame, ts: str, late: str) -> DataFrame:
    return events.withWatermark(ts, late) if events.isStreaming else events


def added(events: DataFrame, known: DataFrame, path: str = "path", ts: str = "ts", late: str = LATE) -> DataFrame:
    """Add events of paths that are not known yet, each path once: a stream-static anti-join and duplicates dropped within the watermark."""
    fresh = _marked(events, ts, late).join(known.select(path), path, "left_anti")
    return fresh.dropDuplicatesWithinWatermark([path]) if events.isStreaming else fresh.dropDuplicates([path])


def unlink_bursts(events: DataFrame, directory: str = "directory", ts: str = "ts", span: str = "2 seconds", least: int = 30, late: str = LATE) -> DataFrame:
    """``directory, start, n``: windows with so many removals that they are a lost disk rather than deletions."""
    w = F.window(ts, span)
    counts = _marked(events, ts, late).groupBy(w.alias("w"), F.col(directory).alias("directory")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least).select("directory", F.col("w.start").alias("start"), "n")


def debounced(events: DataFrame, directory: str = "directory", ts: str = "ts", gap: str = "1500 milliseconds", late: str = LATE) -> DataFrame:
    """``directory, start, end, n``: one rescan for each session of events that are no further apart than ``gap``."""
    s = F.session_window(ts, gap)
    counts = _marked(events, ts, late).groupBy(s.alias("s"), F.col(directory).alias("directory")).agg(F.count("*").alias("n"))
    return counts.select("directory", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def running_counts(events: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """``key, n, last``: counters; write with output mode ``update``. State is one row a key, which is the result itself."""
    return events.groupBy(key).agg(F.count("*").alias("n"), F.max(ts).alias("last"))


def windowed_counts(events: DataFrame, key: str, ts: str = "ts", span: str = "1 hour", late: str = LATE) -> DataFrame:
    """``key, start, n`` over tumbling windows. A stream gives each window once, when no more late rows for it are taken."""
    counts = _marked(events, ts, late).groupBy(F.window(ts, span).alias("w"), F.col(key).alias(key)).agg(F.count("*").alias("n"))
    return counts.select(key, F.col("w.start").alias("start"), "n")


def rates(events: DataFrame, ts: str = "ts", span: str = "4 seconds", slide: str = "1 second", late: str = LATE) -> DataFrame:
    """``start, n, per_second`` over sliding windows: what a window holds over the time from its first event to its end, 0 below one second."""
    w = F.window(ts, span, slide)
    counts = _marked(events, ts, late).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.min(F.unix_millis(F.col(ts).cast("timestamp"))).alias("first"))
    seconds = (F.unix_millis(F.col("w.end").cast("timestamp")) - F.col("first")) / 1000
    return counts.select(F.col("w.start").alias("start"), "n", F.when(seconds >= 1, F.col("n") / seconds).otherwise(0.0).alias("per_second"))


BUCKETS = 16  # of directories; a state holds those of one bucket and one span


class _Waiting(StatefulProcessor):
    """The removals of one bucket of directories and one span: counted by directory, and held (fewer than ``least`` of each) until a timer at the span's end."""

    def __init__(self, span_ms: int, least: int):
        self.span_ms, self.least = span_ms, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "directories array<string>, n array<long>, owners array<int>, paths array<string>, at array<long>")

    def _known(self) -> dict[str | None, tuple[int, dict]]:
        """Each directory's count and the latest time of each path."""
        if not self.held.exists():
            return {}
        directories, n, owners, paths, at = self.held.get()
        latest = [{} for _ in directories]
        for owner, path, ms in zip(owners, paths, at, strict=True):
            latest[owner][path] = ms
        return dict(zip(directories, zip(n, latest, strict=True), strict=True))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self._known()
        for part in rows:
            for directory, path, ms in zip(part["directory"].tolist(), part["path"].tolist(), part["ms"].tolist(), strict=True):
                n, latest = known.get(directory, (0, {}))
                if n + 1 >= self.least:  # a burst: only its count matters from here on
                    latest = {}
                else:
                    latest[path] = max(ms, latest.get(path, ms))
                known[directory] = n + 1, latest
        each = [(i, path, ms) for i, (_, latest) in enumerate(known.values()) for path, ms in latest.items()]
        self.held.update((list(known), [n for n, _ in known.values()], *([r[j] for r in each] for j in range(3))))
        self.handle.registerTimer((int(key[1]) + 1) * self.span_ms)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        lone = [(directory, path, ms) for directory, (_, latest) in self._known().items() for path, ms in latest.items()]
        self.held.clear()
        if lone:
            yield pd.DataFrame(lone, columns=["directory", "path", "ms"])

    def close(self) -> None:
        pass


def removals(events: DataFrame, present: DataFrame | None = None, directory: str = "directory", path: str = "path", ts: str = "ts", span_ms: int = 2000, least: int = 30, late: str = LATE) -> DataFrame:
    """``directory, path, ms``: removals to be marked as missing: of paths that are not ``present``, and not part of a burst (``least`` removals or more of one directory within a span).

    A removal waits for the end of its span, at which its directory's count is known; a path that is removed again within it leaves once, with its last time. State is
    fewer than ``least`` paths for each directory and open span, those of a ``BUCKETS``-th of the directories in one row, as a call for each row costs more than the rows; the watermark's timer ends it.
    Rows behind the watermark are dropped. Run streams of it under ``keyed_state``.
    Over a finished feed the same spans are counted at once.
    """
    at = F.unix_millis(F.col(ts).cast("timestamp"))
    own = events.select(F.col(directory).cast("string").alias("directory"), F.col(path).cast("string").alias("path"), at.alias("ms"), F.floor(at / span_ms).alias("span"), F.col(ts))
    if events.isStreaming:
        bucket = F.pmod(F.xxhash64("directory"), F.lit(BUCKETS))
        dealt = own.withColumn("bucket", bucket).withWatermark(ts, late).groupBy("bucket", "span")
        lone = dealt.transformWithStateInPandas(_Waiting(span_ms, least), "directory string, path string, ms long", "Append", "EventTime")
    else:
        quiet = own.groupBy("directory", "span").agg(F.count("*").alias("n")).where(F.col("n") < least).select("directory", "span")
        lone = own.join(quiet, ["directory", "span"], "left_semi").groupBy("directory", "span", "path").agg(F.max("ms").alias("ms")).select("directory", "path", "ms")
    return lone if present is None else lone.join(present.select(F.col(path).cast("string").alias("path")), "path", "left_anti").select("directory", "path", "ms")


class _Marked(StatefulProcessor):
    """The marked paths of one root with the time until which they hold; a timer each minute of event time removes what holds no longer."""

    def __init__(self, hold_ms: int, columns: list[str]):
        self.hold_ms, self.columns = hold_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getMapState("until", "path string", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values(["marked_ms", "marked_kind", "marked_path"], kind="stable")
        free = []
        for kind, path, ms in zip(new["marked_kind"].tolist(), new["marked_path"].tolist(), new["marked_ms"].tolist(), strict=True):
            if kind == 0:
                held = self.until.getValue((path,))[0] if self.until.containsKey((path,)) else ms
                until = max(held, ms + self.hold_ms)
                self.until.updateValue((path,), (until,))
                self.handle.registerTimer((until // MINUTE + 1) * MINUTE)
            free.append(kind == 1 and not any(self._holds(p, ms) for p in _above(path)))
        yield new.loc[free, self.columns]

    def _holds(self, path: str, ms: int) -> bool:
        return self.until.containsKey((path,)) and ms <= self.until.getValue((path,))[0]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        for path in [path for path, until in self.until.iterator() if until[0] < now]:
            self.until.removeKey(path)
        return iter([])

    def close(self) -> None:
        pass


MINUTE = 60_000


def _above(path: str) -> Iterator[str]:
    """A path and the folders that it is in."""
    while path:
        yield path
        path = path.rpartition("/")[0]


def unsuppressed(events: DataFrame, marks: DataFrame, root: str = "root", path: str = "path", ts: str = "ts", hold_ms: int = 15_000, late: str = LATE) -> DataFrame:
    """Events whose path is not marked, nor a folder that it is in, at their time: a mark holds for ``hold_ms``.

    Events leave at once, with the marks known by then, and do not wait for the watermark; those of one micro-batch go by time, marks first. ``marks``: ``root, path, ts``; both are
    streams. State is one row for each marked path of a root; timers end it. Rows behind the watermark are dropped. Run it under ``keyed_state``.
    """
    ms = F.unix_millis(F.col(ts).cast("timestamp")).alias("marked_ms")
    mine = events.select("*", F.lit(1).alias("marked_kind"), F.col(path).cast("string").alias("marked_path"), ms)
    none = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in (root, ts) else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]
    held = marks.select(*none, F.lit(0).alias("marked_kind"), F.col(path).cast("string").alias("marked_path"), ms)
    both = mine.unionByName(held).withWatermark(ts, late)
    return both.groupBy(root).transformWithStateInPandas(_Marked(hold_ms, events.columns), events.schema, "Append", "EventTime")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Start streams with timers or a time to live inside: their state needs a store on disk, which is chosen when a stream starts."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def suppressed(events: DataFrame, marks: DataFrame, path: str = "path", ts: str = "ts", hold: str = "15 seconds", late: str = LATE) -> DataFrame:
    """Events whose path was not marked within ``hold`` before them: a left outer stream-stream join with a time range, so state ends with the watermark."""
    e = _marked(events, ts, late).alias("e")
    m = _marked(marks.select(F.col(path).alias("m_path"), F.col(ts).alias("m_ts")), "m_ts", late).alias("m")
    within = (F.col(f"e.{path}") == F.col("m.m_path")) & (F.col(f"e.{ts}") >= F.col("m.m_ts")) & (F.col(f"e.{ts}") <= F.col("m.m_ts") + F.expr(f"interval {hold}"))
    return e.join(m, within, "left_outer").where("m.m_path is null").select("e.*")


def tournament_state(log: DataFrame) -> DataFrame:
    """``session, item, rating, comparisons, wins, losses`` after each micro-batch of ``session, seq, a, b, score``; write with output mode ``update``.

    The state of a session is its items' ratings and what each action that can still be undone has replaced, as packed lists; within a
    micro-batch the actions go by ``seq``. The result does not depend on how a log is cut into micro-batches, as long as these come in its order.
    """
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items, ratings, counts, wins, losses, replaced = state.get if state.exists else ([], [], [], [], [], [])
        held = {i: [r, c, w, x] for i, r, c, w, x in zip(items, ratings, counts, wins, losses, strict=True)}
        new = pd.concat(list(parts)).sort_values(["seq", "a", "b"], kind="stable")
        five = [list(map(int, replaced[i : i + 5])) for i in range(0, len(replaced), 5)]
        history = [{x[0]: x[1:], y[0]: y[1:]} for x, y in zip(five[::2], five[1::2], strict=True)]
        held = fold_log(held, zip(new["a"].tolist(), new["b"].tolist(), new["score"].tolist(), strict=True), history)
        rows = sorted(held.items())
        packed = [int(v) for action in history for i, old in (list(action.items()) * 2)[:2] for v in (i, *old)]
        state.update(tuple([[int(i) for i, _ in rows], *([int(v[j]) for _, v in rows] for j in range(4)), packed]))
        yield pd.DataFrame([(key[0], i, *v) for i, v in rows], columns=["session", "item", "rating", "comparisons", "wins", "losses"])

    out = "session long, item long, rating long, comparisons long, wins long, losses long"
    held = "items array<long>, ratings array<long>, counts array<long>, wins array<long>, losses array<long>, replaced array<long>"
    return log.groupBy("session").applyInPandasWithState(step, out, held, "update", GroupStateTimeout.NoTimeout)


def upsert(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer that keeps the latest row of each key by ``order``: a batch is a file of changes, merged into the whole table at times.

    A batch that comes again, after a restart, changes nothing. Read the table with ``KeyedTable(spark, path, key, order).read()``.
    """
    def write(batch: DataFrame, number: int) -> None:
        KeyedTable(batch.sparkSession, path, key, order).apply(batch, batch=number)

    return write


def run_to_table(df: DataFrame, name: str) -> DataFrame:
    """Run an appending stream over what there is into a Parquet table of the shared folder, and return that table.

    Sources, offsets and output are all in shared places, so another driver can go on where this one ended.
    """
    spark = df.sparkSession
    home = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    query = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start(f"{home}/rows")
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(df.schema).parquet(f"{home}/rows")


def run_to_end(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what there is and return the rows of its in-memory sink (for tests and small reports)."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return df.sparkSession.table(name)
